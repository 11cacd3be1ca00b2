"""Hierarchical navigable small-world graph in flat numpy arrays, built and searched for many vectors at once.

Every layer is an (n, links) array of neighbours, -1 where there is none. Nodes enter layer by layer, in an order; each
takes diverse neighbours among the nearest of those before it, and is linked back. On layers of up to `paired` nodes, the
size of a shard, the nearest before a node come from blocked matrix products; larger ones are built by batches that search
the graph of those before them and themselves. Searches keep one sorted row of keys per query: similarity, a bit for
"expanded", and the node, in one 64-bit integer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EXPANDED = np.uint64(1 << 31)
_NODE = np.uint64((1 << 31) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class HNSWConfig:
    m: int = 16               # links on upper layers; twice as many on the lowest
    ef_construction: int = 64
    ef_search: int = 64
    at_once: int = 3          # nodes of a beam expanded in one step
    batch: int = 384
    scanned: int = 4096       # nodes up to which an upper layer is scored as a whole
    paired: int = 65_536      # nodes up to which a layer's candidates come from matrix products
    seed: int = 11


def _keys(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Ascending keys for descending similarity."""
    bits = (np.float32(4.0) - sims.astype(np.float32)).view(np.uint32)
    return (bits.astype(np.uint64) << np.uint64(32)) | nodes.astype(np.uint64)


def _sims_of(keys: np.ndarray) -> np.ndarray:
    return np.float32(4.0) - (keys >> np.uint64(32)).astype(np.uint32).view(np.float32)


class HNSW:
    """Index over unit vectors x (n, d), float32. Similarity is the inner product."""

    def __init__(self, x: np.ndarray, config: HNSWConfig = HNSWConfig()) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.c = config
        n = len(x)
        rng = np.random.default_rng(config.seed)
        u = rng.random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(max(config.m, 2))).astype(int), 32)
        # High nodes first; each layer then holds a prefix of the order.
        self.order = np.argsort(-level, kind="stable")
        top = int(level.max(initial=0))
        self.layers: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        for l in range(top, -1, -1):
            members = self.order[: int((level >= l).sum())]
            links = 2 * config.m if l == 0 else config.m
            self._build(members, np.full((n, links), -1, np.int32))

    @classmethod
    def of_layers(cls, x: np.ndarray, level: np.ndarray, layers: list[np.ndarray], config: HNSWConfig) -> HNSW:
        """An index from what a file holds: levels of the nodes, and link arrays from the top layer down."""
        index = cls(x[:0], config)
        index.x, index.layers = np.ascontiguousarray(x, np.float32), layers
        index.order = np.argsort(-level, kind="stable")
        index.members = [index.order[: int((level >= k).sum())] for k in range(len(layers) - 1, -1, -1)]
        return index

    def _build(self, members: np.ndarray, links: np.ndarray) -> None:
        """Add a layer below the present ones."""
        first = min(len(members), 128)
        seed = members[:first]
        if first > 1:
            sims = self.x[seed] @ self.x[seed].T
            np.fill_diagonal(sims, -2)
            width = min(first - 1, 2 * links.shape[1])
            near = np.argsort(-sims, axis=1)[:, :width]
            links[seed] = self._select(np.take_along_axis(sims, near, 1), seed[near], links.shape[1])
        done = first
        if first < len(members) <= self.c.paired:
            done = len(members)
            chosen = np.full((done - first, self.c.m if links.shape[1] > self.c.m else links.shape[1]), -1, np.int32)
            for a, b, near, sims in self._nearest_before(members, first, self.c.ef_construction):
                chosen[a - first:b - first] = self._select(sims, near, chosen.shape[1])
            links[members[first:], : chosen.shape[1]] = chosen
            self._link_back(members[first:], chosen, links)
        while done < len(members):
            size = min(4 * self.c.batch, max(128, done // 2), len(members) - done)
            batch = members[done:done + size]
            entry = self._entry(self.x[batch], members[0])
            ids, sims = self._search_layer(self.x[batch], entry, links, self.c.ef_construction)
            # The batch's own members, which are not in the graph yet.
            own = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(own, -2)
            k = min(8, size - 1)
            if k > 0:
                near = np.argpartition(-own, k - 1, axis=1)[:, :k] if k < size else np.tile(np.arange(size), (size, 1))
                ids = np.concatenate([ids, batch[near]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            rank = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
            chosen = self._select(sims, ids, self.c.m if links.shape[1] > self.c.m else links.shape[1])
            links[batch, : chosen.shape[1]] = chosen
            self._link_back(batch, chosen, links)
            done += size
        self.layers.append(links)
        self.members.append(members)

    def _nearest_before(self, members: np.ndarray, first: int, k: int):
        """(begin, end, ids, similarities) by blocks of members from `first` on: the k nearest of those before each, best first."""
        y, n, fold = self.x[members], len(members), 32
        at = first
        while at < n:
            end = min(n, at + max(64, min(1024, 6_000_000 // n)))
            width = -(-end // fold)
            s = np.full((end - at, fold * width), -3, np.float32)
            np.matmul(y[at:end], y[:end].T, out=s[:, :end])
            s[:, at:end][np.arange(end - at)[:, None] <= np.arange(end - at)] = -3
            # The k best lie in the k groups of columns with the best maxima.
            if width > k:
                folded = s.reshape(end - at, fold, width)
                groups = np.argpartition(-folded.max(axis=1), k - 1, axis=1)[:, :k]
                s = np.take_along_axis(folded, groups[:, None, :], 2).reshape(end - at, fold * k)
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            sims = np.take_along_axis(s, top, 1)
            column = top // k * width + np.take_along_axis(groups, top % k, 1) if width > k else top
            rank = np.argsort(-sims, axis=1)
            sims, column = np.take_along_axis(sims, rank, 1), np.take_along_axis(column, rank, 1)
            yield at, end, np.where(sims > -2, members[np.minimum(column, n - 1)], -1), sims
            at = end

    def _select(self, sims: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """Up to m diverse neighbours of each row's candidates, best first; skipped ones fill what is left. -1: none."""
        out = np.full((len(ids), m), -1, np.int32)
        for at in range(0, len(ids), 256):
            s, i = sims[at:at + 256], ids[at:at + 256]
            b, c = s.shape
            valid = (i >= 0) & (s > -2)
            v = self.x[np.maximum(i, 0)]
            g = v @ v.transpose(0, 2, 1)
            nearest = np.full((b, c), -3, np.float32)
            kept = np.zeros((b, c), bool)
            count = np.zeros(b, int)
            for k in range(c):
                take = np.flatnonzero(valid[:, k] & (s[:, k] > nearest[:, k]) & (count < m))
                if not len(take):
                    if (count >= m).all():
                        break
                    continue
                kept[take, k] = True
                count[take] += 1
                nearest[take] = np.maximum(nearest[take], g[take, k])
            order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :m]
            best = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(i, order, 1), -1)
            out[at:at + len(best), : best.shape[1]] = best
        return out

    def _link_back(self, batch: np.ndarray, chosen: np.ndarray, links: np.ndarray) -> None:
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        has = target >= 0
        source, target = source[has], target[has]
        near = np.concatenate([np.vecdot(self.x[source[a:a + 65_536]], self.x[target[a:a + 65_536]]) for a in range(0, len(source), 65_536)] or [np.empty(0, np.float32)])
        order = np.lexsort((-near, target))  # the nearest first, so links beyond the waiting ones could not be chosen
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = links.shape[1]
        used = (links[nodes] >= 0).sum(axis=1)
        slot = np.arange(len(target)) - np.repeat(first, count)
        room = np.repeat(width - used, count)
        fits = slot < room
        at = np.repeat(used, count) + slot
        links[target[fits], at[fits]] = source[fits]
        full = np.flatnonzero(used + count > width)
        if not len(full):
            return
        # Choose anew among present and waiting links.
        row = np.full(len(nodes), -1, np.int64)
        row[full] = np.arange(len(full))
        left = np.flatnonzero(~fits)
        column = (slot - room)[left]
        waiting = np.full((len(full), min(int(column.max()) + 1, width + 16)), -1, np.int64)
        kept = column < waiting.shape[1]
        waiting[row[np.repeat(np.arange(len(nodes)), count)[left[kept]]], column[kept]] = source[left[kept]]
        both = np.concatenate([links[nodes[full]].astype(np.int64), waiting], axis=1)
        for at in range(0, len(full), 2048):
            ids, own = both[at:at + 2048], nodes[full[at:at + 2048]]
            sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[np.maximum(ids, 0)], self.x[own]), np.float32(-3))
            rank = np.argsort(-sims, axis=1)[:, : width + 16]
            links[own] = self._select(np.take_along_axis(sims, rank, 1), np.take_along_axis(ids, rank, 1), width)

    def _entry(self, q: np.ndarray, start: int) -> np.ndarray:
        """Best node for each query on the layers built so far, from the top down.

        A layer of few nodes is scored as a whole: one matrix product is less work than walking down to it.
        """
        if self.layers and len(self.members[len(self.layers) - 1]) <= self.c.scanned:
            nodes = self.members[len(self.layers) - 1]
            best = [(q[a:a + 2048] @ self.x[nodes].T).argmax(axis=1) for a in range(0, len(q), 2048)]
            return nodes[np.concatenate(best)][:, None]
        at = np.full((len(q), 1), start, np.int64)
        for links in self.layers:
            ids, _ = self._search_layer(q, at, links, 4)
            at = np.maximum(ids[:, :1], 0)
        return at

    def _search_layer(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -3, np.float32)
        n, b = len(self.x), self.c.batch
        # A node n beyond the last stands for "none": it is always seen and has no links, so no step needs a mask.
        padded = np.full((n + 1, links.shape[1]), n, np.int64)
        padded[:n] = np.where(links < 0, n, links)
        for at in range(0, len(q), b):
            part = np.ascontiguousarray(q[at:at + b])
            ids[at:at + b], sims[at:at + b] = self._beam(part, entry[at:at + b], padded, ef)
        return ids, sims

    def _beam(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, step, width = len(self.x), self.c.at_once, self.c.at_once * links.shape[1]
        seen = np.zeros((len(q), n + 1), np.uint8)
        seen[:, n] = 1
        np.put_along_axis(seen, entry, 1, axis=1)
        seen = seen.ravel()
        beam = np.full((len(q), ef), _NONE, np.uint64)
        sims = np.einsum("bd,bed->be", q, self.x[entry])
        beam[:, : entry.shape[1]] = np.sort(_keys(sims, entry), axis=1)[:, :ef]
        active = np.arange(len(q))
        b = beam
        while True:
            fresh = (b & _EXPANDED) == 0  # a missing key has all bits
            some = fresh.any(axis=1)
            if not some.all():
                beam[active[~some]] = b[~some]
                active, b, fresh = active[some], b[some], fresh[some]
            if not len(active):
                break
            order = np.cumsum(fresh, axis=1, dtype=np.int16)
            at = np.flatnonzero(fresh & (order <= step))
            keys = b.ravel()
            picked = keys.take(at)
            nodes = np.full(len(active) * step, n, np.int64)
            nodes[(at // ef) * step + order.ravel().take(at) - 1] = (picked & _NODE).astype(np.int64)
            keys[at] = picked | _EXPANDED
            near = links.take(nodes, axis=0, mode="clip").reshape(len(active), width)
            flat = (near + (active * (n + 1))[:, None]).ravel()
            new = np.flatnonzero(seen.take(flat, mode="clip") == 0)
            seen[flat.take(new, mode="clip")] = 1
            who = near.ravel().take(new, mode="clip")
            sims = np.vecdot(q.take(active.take(new // width), axis=0, mode="clip"), self.x.take(who, axis=0, mode="clip"))
            more = np.full(len(active) * width, _NONE, np.uint64)
            more[new] = _keys(sims, who)
            merged = np.concatenate([keys.reshape(b.shape), more.reshape(len(active), width)], axis=1)
            merged.sort(axis=1)
            # A node met twice in one step has two equal keys side by side.
            twice = merged[:, 1:ef] == merged[:, : ef - 1]
            b = np.ascontiguousarray(merged[:, :ef])
            if twice.any():
                b[:, 1:][twice] = _NONE
                b.sort(axis=1)
        found = beam != _NONE
        return np.where(found, (beam & _NODE).astype(np.int64), -1), np.where(found, _sims_of(beam), np.float32(-3))

    def search(self, q: np.ndarray, k: int, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the k nearest of each query, best first; -1 where there are fewer. entry: nodes to start at."""
        q = np.ascontiguousarray(q, np.float32)
        if not len(self.x) or not len(q):
            return np.full((len(q), k), -1, np.int64), np.full((len(q), k), -3, np.float32)
        if entry is None:
            upper, self.layers = self.layers, self.layers[:-1]
            try:
                entry = self._entry(q, int(self.order[0]))
            finally:
                self.layers = upper
        ids, sims = self._search_layer(q, entry, self.layers[-1], max(self.c.ef_search, k))
        return ids[:, :k], sims[:, :k]
