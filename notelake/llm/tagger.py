"""Character-level bidirectional LSTM with CRF transitions in numpy: training, and decoding of whole texts.

A text is read in overlapping windows; the windows' emissions are blended, those near a window's middle counting
most, and one Viterbi path is decoded over the whole text. Positions at which no transition could outweigh the
emission for "outside" are fixed first, exactly, so that only the stretches between them are decoded step by step.
"""

from __future__ import annotations

import io
import multiprocessing
import time
import unicodedata
from collections import Counter
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N_TAGS = len(TAGS)
#: Classes for characters outside the vocabulary; ids 0..9, 0 pads.
CLASSES = ("pad", "han", "kana", "lower", "upper", "digit", "letter", "blank", "mark", "line")


@dataclass(frozen=True)
class TaggerConfig:
    window: int = 160
    stride: int = 112
    hidden: int = 48
    embedding: int = 32
    vocabulary: int = 900
    steps: int = 1400
    batch: int = 192
    length: int = 128          # of training windows
    rate: float = 0.004
    seed: int = 1


def _class_of(ch: str) -> int:
    cp, cat = ord(ch), unicodedata.category(ch)
    if ch in "\n\r\x0b\x0c\x85\u2028\u2029":
        return 9
    if cat == "Zs" or ch == "\t":
        return 7
    if 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or ch == "々":
        return 1
    if 0x3040 <= cp <= 0x30FF:
        return 2
    if cat == "Nd":
        return 5
    if cat == "Ll":
        return 3
    if cat == "Lu":
        return 4
    return 6 if cat[0] in "LM" else 8


def _fold(ch: str) -> str:
    """Width is no feature, and all digits are one."""
    cp = ord(ch)
    if 0xFF01 <= cp <= 0xFF5E:
        ch = chr(cp - 0xFEE0)
    return "0" if unicodedata.category(ch) == "Nd" else ch


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray], config: TaggerConfig) -> None:
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items() if k != "chars"}
        self.chars = str(weights["chars"])
        self.c = config
        self.ids = {ch: 10 + i for i, ch in enumerate(self.chars)}
        self._table: np.ndarray | None = None

    def save(self, path: str) -> None:
        w = {k: v.astype(np.float16) for k, v in self.w.items()}
        np.savez_compressed(path, chars=np.array(self.chars), config=np.array(repr(asdict(self.c))), **w)

    @staticmethod
    def load(data: bytes) -> Tagger:
        import ast

        z = np.load(io.BytesIO(data))
        w = {k: z[k] for k in z.files if k not in ("chars", "config")}
        return Tagger(w | {"chars": str(z["chars"])}, TaggerConfig(**ast.literal_eval(str(z["config"]))))

    def encode(self, cps: np.ndarray) -> np.ndarray:
        """Character ids of code points."""
        if self._table is None:
            t = np.full(0x10000, 8, np.int32)
            for cp in range(0x10000):
                if not 0xD800 <= cp <= 0xDFFF:
                    ch = _fold(chr(cp))
                    t[cp] = self.ids.get(ch, _class_of(ch))
            self._table = t
        return np.where(cps > 0xFFFF, 8, self._table[np.minimum(cps, 0xFFFF)])

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """x (windows, length) of ids -> (windows, length, tags)."""
        b, n = x.shape
        h = self.c.hidden
        out = np.zeros((n, b, N_TAGS), np.float32)
        out += self.w["bo"]
        for side in "fb":
            # Sigmoids as tanh: the tables of the input's share, and the recurrent weights, are halved for the gates.
            half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])
            table = (self.w["emb"] @ self.w[f"wx{side}"] + self.w[f"b{side}"]) * half
            u = self.w[f"wh{side}"] * half
            wo = self.w[f"wo{side}"]
            state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            g, more, tc = np.empty((b, 4 * h), np.float32), np.empty((b, 4 * h), np.float32), np.empty((b, h), np.float32)
            gates = g[:, : 3 * h]
            columns = np.ascontiguousarray(x.T)
            for t in range(n) if side == "f" else range(n - 1, -1, -1):
                table.take(columns[t], axis=0, out=g, mode="clip")
                np.matmul(state, u, out=more)
                g += more
                np.tanh(g, out=g)
                gates *= 0.5
                gates += 0.5
                cell *= g[:, h:2 * h]
                np.multiply(g[:, :h], g[:, 3 * h:], out=tc)
                cell += tc
                np.tanh(cell, out=tc)
                np.multiply(g[:, 2 * h:3 * h], tc, out=state)
                out[t] += state @ wo
        return out.transpose(1, 0, 2)

    def text_emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Blended emissions (sum of lengths, tags) of texts whose ids are joined."""
        begins = np.concatenate([[0], np.cumsum(lengths)])
        win, stride = self.c.window, self.c.stride
        starts, owner = [], []
        for k, n in enumerate(lengths.tolist()):
            at = list(range(0, max(n - win, 0) + stride, stride)) if n > win else [0]
            at = [min(a, max(n - win, 0)) for a in at]
            at = sorted(set(at))
            starts += at
            owner += [k] * len(at)
        starts, owner = np.array(starts, np.int64), np.array(owner, np.int64)
        total = np.zeros((len(ids), N_TAGS), np.float32)
        weight = np.zeros(len(ids), np.float32)
        full = 1.0 + np.minimum(np.arange(win), np.arange(win)[::-1]).astype(np.float32)
        # Windows of like lengths go together; blocks of 256 stay within the processor's cache.
        by_length = np.argsort(np.minimum(lengths[owner], win), kind="stable")
        for at in range(0, len(starts), 256):
            rows = by_length[at:at + 256]
            o, s = owner[rows], starts[rows]
            longest = int(np.minimum(lengths[o], win).max())
            offset, tent = np.arange(longest), full[:longest]
            pos = begins[o][:, None] + s[:, None] + offset
            inside = (s[:, None] + offset) < lengths[o][:, None]
            x = np.where(inside, ids[np.minimum(pos, len(ids) - 1)], 0) if len(ids) else np.zeros(pos.shape, np.int64)
            e = self._emissions(x) * tent[None, :, None]
            # Windows of one text overlap with their neighbours; every third one is added at a time, so none is lost.
            for turn in range(3):
                those = (s // stride + (s % stride > 0)) % 3 == turn
                m = inside[those]
                at_ = pos[those][m]
                total[at_] += e[those][m]
                weight[at_] += np.broadcast_to(tent, m.shape)[m]
        return total / np.maximum(weight, 1e-6)[:, None]

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag path of each text, by emissions and transitions; texts are joined."""
        trans, begin = self.w["trans"], self.w["begin"]
        n = len(e)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        edge = np.zeros(n + 1, bool)
        edge[np.concatenate([[0], np.cumsum(lengths)])] = True
        # Putting "outside" in place of tag k loses at most this by its two transitions.
        bound = (trans - trans[:, :1]).max(axis=0) + (trans - trans[:1]).max(axis=1)
        bound = np.maximum(bound, (begin - begin[0]) + (trans - trans[:1]).max(axis=1))
        open_ = ((e[:, :1] - e[:, 1:]) <= bound[1:]).any(axis=1)
        first = open_ & (edge[:-1] | ~np.concatenate([[False], open_[:-1]]))
        starts = np.flatnonzero(first)
        if not len(starts):
            return tags
        ends = np.append(starts[1:], n)
        run_end = np.flatnonzero(open_ & (edge[1:] | ~np.concatenate([open_[1:], [False]]))) + 1
        ends = run_end[: len(starts)]
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            group = order[at:at + 2048]
            longest = int(sizes[group].max())
            if longest > 400 and len(group) > 64:
                group = group[:64]
                longest = int(sizes[group].max())
            self._viterbi(e, starts[group], sizes[group], edge, tags, trans, begin, longest)
            at += len(group)
        return tags

    @staticmethod
    def _viterbi(e, starts, sizes, edge, tags, trans, begin, longest) -> None:
        b = len(starts)
        # A stretch begins at a text's begin, or after a fixed "outside"; it ends at a text's end, or before one.
        score = e[starts] + np.where(edge[starts][:, None], begin, trans[0])
        back = np.zeros((longest, b, N_TAGS), np.int8)
        for t in range(1, longest):
            on = sizes > t
            if not on.any():
                break
            via = score[on][:, :, None] + trans
            back[t, on] = via.argmax(axis=1)
            score[on] = via.max(axis=1) + e[starts[on] + t]
        last = starts + sizes
        score = score + np.where(edge[last][:, None], 0, trans[:, 0])
        tag = score.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            on = sizes > t
            tags[starts[on] + t] = tag[on]
            if t:
                tag[on] = back[t, on, tag[on]]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) found in each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        e = self.text_emissions(self.encode(cps), lengths)
        tags = self.decode(e, lengths)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        begins = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.flatnonzero(tags)
        if not len(inside):
            return out
        kind = (tags[inside] - 1) // 2
        owner = np.searchsorted(begins, inside, side="right") - 1
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(inside) > 1) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1]) | (tags[inside][1:] % 2 == 1)
        at = np.flatnonzero(new)
        for a, b in zip(at, np.append(at[1:], len(inside)), strict=True):
            k = int(owner[a])
            out[k].append((int(inside[a] - begins[k]), int(inside[b - 1] - begins[k]) + 1, KINDS[int(kind[a])]))
        return out


# ---- training ----


def _windows(data, ids_of, c: TaggerConfig, rng) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: around every span at a random offset, and as many quiet ones."""
    xs, ys = [], []
    for text, spans in data:
        n = len(text)
        if not n:
            continue
        ids = ids_of(text)
        y = np.zeros(n, np.int8)
        for a, b, kind in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[a:b] = k + 1
            y[a] = k
        places = [a - int(rng.integers(0, c.length)) for a, _, _ in spans] + [int(rng.integers(0, n)) - c.length // 2 for _ in range(1 + len(spans) // 4 + n // 1_500)]
        for p in places:
            p = min(max(p, 0), max(n - c.length, 0))
            x, t = ids[p:p + c.length], y[p:p + c.length]
            pad = c.length - len(x)
            xs.append(np.pad(x, (0, pad)))
            ys.append(np.pad(t, (0, pad)))
    return np.array(xs, np.int32), np.array(ys, np.int8)


def _crf(e, y, trans, begin):
    """Negative log likelihood per window and gradients; e (n, b, k), y (n, b). Paths run over the padding as "outside".

    Forward and backward sums in scaled probabilities: a matrix product a step.
    """
    n, b, k = e.shape
    top = e.max(axis=2, keepdims=True)
    p_e, p_trans = np.exp(e - top), np.exp(trans - trans.max())
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, b, 1))
    first = np.exp(begin - begin.max()) * p_e[0]
    scale[0] = first.sum(axis=1, keepdims=True)
    alpha[0] = first / scale[0]
    for t in range(1, n):
        step = (alpha[t - 1] @ p_trans) * p_e[t]
        scale[t] = step.sum(axis=1, keepdims=True)
        alpha[t] = step / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = (p_e[t + 1] * beta[t + 1] / scale[t + 1]) @ p_trans.T
    z = np.log(scale).sum(axis=(0, 2)) + top.sum(axis=(0, 2)) + begin.max() + (n - 1) * trans.max()
    rows = np.arange(b)
    gold = begin[y[0]] + e[np.arange(n)[:, None], rows[None], y].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
    after = (p_e[1:] * beta[1:] / scale[1:]).reshape(-1, k)
    g_trans = p_trans * (alpha[:-1].reshape(-1, k).T @ after)
    np.add.at(g_trans, (y[:-1].ravel(), y[1:].ravel()), -1)
    g_e = alpha * beta
    g_e[np.arange(n)[:, None], rows[None], y] -= 1
    g_begin = g_e[0].sum(axis=0)
    return float((z - gold).mean()), g_e / b, g_trans / b, g_begin / b


def _lstm(x, table_in, wx, wh, bias, reverse):
    n, b = x.shape[1], x.shape[0]
    h = wh.shape[0]
    state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    table = table_in @ wx + bias
    states, cells, gates = np.empty((n, b, h), np.float32), np.empty((n, b, h), np.float32), np.empty((n, b, 4 * h), np.float32)
    for t in range(n - 1, -1, -1) if reverse else range(n):
        g = table[x[:, t]] + state @ wh
        g[:, : 3 * h] = 0.5 * np.tanh(0.5 * g[:, : 3 * h]) + 0.5
        g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
        cell = g[:, h:2 * h] * cell + g[:, :h] * g[:, 3 * h:]
        state = g[:, 2 * h:3 * h] * np.tanh(cell)
        states[t], cells[t], gates[t] = state, cell, g
    return states, cells, gates


def _lstm_back(x, emb, wx, wh, saved, d_states, reverse):
    states, cells, gates = saved
    n, b, h = states.shape
    d_all = np.empty((n, b, 4 * h), np.float32)
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    back = np.ascontiguousarray(wh.T)
    none = np.zeros((b, h), np.float32)
    for t in range(n) if reverse else range(n - 1, -1, -1):
        p = t + 1 if reverse else t - 1
        g, d = gates[t], d_all[t]
        i, f, o, z = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
        tc = np.tanh(cells[t])
        dh += d_states[t]
        dc += dh * o * (1 - tc * tc)
        d[:, :h] = dc * z * i * (1 - i)
        d[:, h:2 * h] = dc * (cells[p] if 0 <= p < n else none) * f * (1 - f)
        d[:, 2 * h:3 * h] = dh * tc * o * (1 - o)
        d[:, 3 * h:] = dc * i * (1 - z * z)
        dh, dc = d @ back, dc * f
    before, own = (states[1:], d_all[:-1]) if reverse else (states[:-1], d_all[1:])
    d_wh = before.reshape(-1, h).T @ own.reshape(-1, 4 * h)
    flat, ids = d_all.reshape(-1, 4 * h), x.T.ravel()
    order = np.argsort(ids, kind="stable")
    seen, first = np.unique(ids[order], return_index=True)
    d_table = np.zeros((len(emb), 4 * h), np.float32)
    d_table[seen] = np.add.reduceat(flat[order], first, axis=0)
    return d_table @ wx.T, emb.T @ d_table, d_wh, flat.sum(axis=0)


def _gradients(w, x, y, rng) -> tuple[float, dict[str, np.ndarray]]:
    h = len(w["whf"])
    saved = {s: _lstm(x, w["emb"], w[f"wx{s}"], w[f"wh{s}"], w[f"b{s}"], s == "b") for s in "fb"}
    drop = {s: (rng.random((1, len(x), h)) > 0.15).astype(np.float32) / 0.85 for s in "fb"}
    e = sum(((saved[s][0] * drop[s]) @ w[f"wo{s}"] for s in "fb"), w["bo"])
    loss, g_e, g_trans, g_begin = _crf(e.astype(np.float64), y, w["trans"].astype(np.float64), w["begin"].astype(np.float64))
    g_e = g_e.astype(np.float32)
    grads = {"trans": g_trans, "begin": g_begin, "bo": g_e.sum(axis=(0, 1)), "emb": 0}
    for s in "fb":
        hidden = saved[s][0] * drop[s]
        grads[f"wo{s}"] = hidden.reshape(-1, h).T @ g_e.reshape(-1, N_TAGS)
        d_emb, grads[f"wx{s}"], grads[f"wh{s}"], grads[f"b{s}"] = _lstm_back(x, w["emb"], w[f"wx{s}"], w[f"wh{s}"], saved[s], (g_e @ w[f"wo{s}"].T) * drop[s], s == "b")
        grads["emb"] = grads["emb"] + d_emb
    return loss, grads


def _serve(pipe, number: int, xs, ys, fallback, c: TaggerConfig, share: int) -> None:
    """A worker: weights in, the gradients of its share of a batch out."""
    rng = np.random.default_rng((c.seed, number))
    while (w := pipe.recv()) is not None:
        pick = rng.integers(0, len(xs), share)
        x = np.where(rng.random((share, xs.shape[1])) < 0.03, fallback[xs[pick]], xs[pick])
        pipe.send(_gradients(w, x, ys[pick].astype(np.int64).T, rng))


def train(data, c: TaggerConfig, quiet: bool = False, workers: int = 1) -> Tagger:
    """Fit on (text, spans) pairs; each of `workers` processes takes a share of every batch."""
    rng = np.random.default_rng(c.seed)
    fold = lru_cache(maxsize=None)(_fold)
    count = Counter(fold(ch) for text, _ in data for ch in text)
    chars = "".join(sorted(ch for ch, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: c.vocabulary]))
    h, d = c.hidden, c.embedding
    w = {"emb": rng.normal(0, 0.3, (10 + len(chars), d)), "bo": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS)), "begin": np.zeros(N_TAGS)}
    for side in "fb":
        w[f"wx{side}"] = rng.normal(0, d ** -0.5, (d, 4 * h))
        w[f"wh{side}"] = rng.normal(0, h ** -0.5, (h, 4 * h)) * 0.7
        w[f"b{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        w[f"wo{side}"] = rng.normal(0, h ** -0.5, (h, N_TAGS))
    for k in range(len(KINDS)):  # an inner tag follows only its own kind
        w["trans"][:, 2 + 2 * k] = -4
        w["trans"][[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 1
        w["begin"][2 + 2 * k] = -4
    w = {k: v.astype(np.float32) for k, v in w.items()}
    probe = Tagger(w | {"chars": chars}, c)
    xs, ys = _windows(data, lambda t: probe.encode(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")), c, rng)
    fallback = np.arange(len(w["emb"]))
    for ch, i in probe.ids.items():
        fallback[i] = _class_of(ch)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    share = -(-c.batch // workers)
    fork = multiprocessing.get_context("fork")
    pipes, processes = [], []
    for k in range(workers):
        mine, theirs = fork.Pipe()
        processes.append(fork.Process(target=_serve, args=(theirs, k, xs, ys, fallback, c, share), daemon=True))
        processes[-1].start()
        pipes.append(mine)
    mean, began = None, time.time()
    for step in range(1, c.steps + 1):
        for p in pipes:
            p.send(w)
        got = [p.recv() for p in pipes]
        loss = sum(x for x, _ in got) / workers
        grads = {k: sum(g[k] for _, g in got) / workers for k in w}
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        rate = c.rate * min(1.0, step / 50) * (1.0 if step < 0.5 * c.steps else 0.05 + 0.95 * 2 * (1 - step / c.steps))
        for k, g in grads.items():
            g = np.asarray(g * min(1.0, 5.0 / (norm + 1e-9)), np.float32)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.995 * m2[k] + 0.005 * g * g
            w[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.995 ** step)) + 1e-8)
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        if not quiet and step % 50 == 0:
            print(f"step {step}: loss {mean:.3f}, {time.time() - began:.0f} s", flush=True)
    for p, worker in zip(pipes, processes, strict=True):
        p.send(None)
        worker.join()
    return Tagger(w | {"chars": chars}, c)
