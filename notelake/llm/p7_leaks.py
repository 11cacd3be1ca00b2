"""Problem 7: evaluation passages on corpus pages, by an FM-index per shard of pages.

A page becomes a stream of letters and digits (no case, accents, blanks, punctuation or hyphens; lines in
printed order by their boxes), so line breaks and broken words don't matter. Each shard of pages gets an
FM-index; windows of the items that few items share are searched backward and located (all windows of an item
that shares many of its own; items of equal text are searched once). Pages with
enough of an item's windows are then checked exactly: all windows of the item on the page are chained in
order, and the item's words that the chain covers are counted. Matched stretches are merged to spans.

The items are a fixed held-out set and go to every task; pages are cut into shards by symbols, so neither
a hot newspaper nor a long page matters: a page longer than a shard is searched in pieces and checked as a whole.

Null or empty page texts and items leak nothing. Boxes that are null or don't fit the lines leave scan order.
Repeated pages are reported under each id; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import runtime
from notelake.llm.fm_index import FMIndex


@dataclass(frozen=True)
class LeakConfig:
    window: int = 10            # symbols per searched window; an ideograph or kana takes two
    shared_by: int = 3          # windows of more items than this are searched only for items that can't do without them
    least_windows: float = 0.28  # share of an item's telling windows on a page that makes it a candidate
    least_words: float = 0.5    # share of an item's words that must stand on the page
    density: float = 0.85       # matched share of the passage, from its first to its last matched symbol
    shard_symbols: int = 900_000
    gap_symbols: int = 1_500    # symbols without a match that begin a new part of a passage (after an advert, another column)
    part_words: int = 6         # words that a part must hold densely to be joined with others; fewer are turns of phrase


def _symbols_of(cp: int) -> list[int]:
    """a-z 1..26, digits 27..31 in pairs, other letters two symbols by remainder; none for all else."""
    out: list[int] = []
    for ch in unicodedata.normalize("NFKD", chr(cp)).lower():
        if "a" <= ch <= "z":
            out.append(ord(ch) - 96)
        elif ch in "ſß":
            out += [19] if ch == "ſ" else [19, 19]
        elif ch.isdigit() and ch.isascii():
            out.append(27 + int(ch) // 2)
        elif ch.isalnum():
            out += [1 + ord(ch) % 31, 1 + ord(ch) // 31 % 31]
    return out[:2]


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """(65536, 2) symbols of each code point of the basic plane; 0 for none."""
    t = np.zeros((0x10000, 2), np.uint8)
    for cp in range(0x10000):
        if not 0xD800 <= cp <= 0xDFFF:
            for k, x in enumerate(_symbols_of(cp)):
                t[cp, k] = x
    return t


def _printed_order(x0, x1, y0, n_lines: int) -> np.ndarray | None:
    """Order of the lines in print: columns from the left, each from the top; None for the order as it is."""
    if x0 is None or x1 is None or y0 is None or n_lines < 3 or not len(x0) == len(x1) == len(y0) == n_lines:
        return None
    x0, x1, y0 = (np.asarray(v, float) for v in (x0, x1, y0))
    wide = float(x1.max() - x0.min())
    if not np.isfinite(wide) or not np.isfinite(y0).all() or not np.isfinite(x0).all():
        return None
    xs = np.sort(x0)
    cuts = xs[1:][np.diff(xs) > max(0.2 * wide, 1)]
    order = np.lexsort((y0, np.searchsorted(cuts, x0, side="right")))
    return None if (np.diff(order) > 0).all() else order


def page_streams(texts: list[str], boxes: list[tuple] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its symbols in printed order, and the code point each comes from. boxes: x0, x1, y0 of its lines."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at = np.arange(len(cps))
    if boxes is not None:
        for k, (x0, x1, y0) in enumerate(boxes):
            ends = np.flatnonzero(cps[begins[k]:begins[k + 1]] == 10)
            order = _printed_order(x0, x1, y0, len(ends) + 1)
            if order is not None:
                starts = np.concatenate([[0], ends + 1])
                stops = np.concatenate([ends + 1, [begins[k + 1] - begins[k]]])
                at[begins[k]:begins[k + 1]] = begins[k] + np.concatenate([np.arange(starts[i], stops[i]) for i in order])
    ordered = cps[at]
    symbols = _tables()[np.minimum(ordered, 0xFFFF)]
    far = np.flatnonzero(ordered > 0xFFFF)
    symbols[far, 0], symbols[far, 1] = 1 + ordered[far] % 31, 1 + ordered[far] // 31 % 31
    flat = symbols.ravel()
    keep = np.flatnonzero(flat)
    source = keep >> 1
    cuts = np.searchsorted(source, begins)
    flat, at = flat[keep], at[source]
    return [(flat[cuts[k]:cuts[k + 1]], at[cuts[k]:cuts[k + 1]] - begins[k]) for k in range(len(texts))]


def words_of(text: str) -> list[tuple[int, int]]:
    """Word spans of a text; without blanks between ideographs each letter is a word."""
    out: list[tuple[int, int]] = []
    start = None
    for i, ch in enumerate(text + " "):
        wide = "⺀" <= ch
        if start is not None and (wide or not (ch.isalnum() or ch in "'’-.,") or ch.isspace()):
            out.append((start, i))
            start = None
        if wide and ch.isalnum():
            out.append((i, i + 1))
        elif not wide and ch.isalnum() and start is None:
            start = i
    return out


class Item:
    """An evaluation item: its symbols, and the word that each symbol belongs to."""

    def __init__(self, item_id: int, text: str, width: int) -> None:
        self.item_id = item_id
        self.symbols, origin = page_streams([text])[0]
        words = words_of(text)
        starts = np.array([a for a, _ in words] or [0])
        self.word = np.searchsorted(starts, origin, side="right") - 1
        self.n_words = len(words)
        self.codes = window_codes(self.symbols, width)


def window_codes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Each window of symbols as one integer (5 bits a symbol, so up to 12 symbols)."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    s = symbols.astype(np.int64)
    code = np.zeros(n, np.int64)
    for j in range(width):
        code = (code << 5) | s[j:j + n]
    return code


def _increasing(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Indexes of a longest chain with offsets and positions both rising (patience sorting)."""
    order = np.lexsort((-positions, offsets))
    tails: list[int] = []
    tops: list[int] = []
    back = np.full(len(order), -1)
    for i in order.tolist():
        p = int(positions[i])
        k = bisect_left(tails, p)
        back[i] = tops[k - 1] if k else -1
        if k == len(tails):
            tails.append(p)
            tops.append(i)
        else:
            tails[k] = p
            tops[k] = i
    chain = []
    i = tops[-1] if tops else -1
    while i >= 0:
        chain.append(i)
        i = int(back[i])
    return np.array(chain[::-1], np.int64)


def check_item(item: Item, page: np.ndarray, c: LeakConfig) -> tuple[int, np.ndarray] | None:
    """(words of the item on the page, page symbols matched), or None if it is not there."""
    w = c.window
    codes = window_codes(page, w)
    if not len(codes) or not len(item.codes):
        return None
    order = np.argsort(item.codes, kind="stable")
    known = item.codes[order]
    lo = np.searchsorted(known, codes, "left")
    hi = np.searchsorted(known, codes, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return None
    reps = (hi - lo)[hit]
    positions = np.repeat(hit, reps)
    inner = np.arange(len(positions)) - np.repeat(np.cumsum(reps) - reps, reps)
    offsets = order[np.repeat(lo[hit], reps) + inner]
    firm = _firm(offsets, positions, w)
    found = _passage(item, offsets[firm], positions[firm], c)
    if found[0] < c.least_words * item.n_words and not firm.all():
        found = _passage(item, offsets, positions, c)  # so many misread letters that no two windows' length stays whole
    return found if found[0] else None


def _firm(offsets: np.ndarray, positions: np.ndarray, w: int) -> np.ndarray:
    """Matches in runs of two windows' length on one diagonal; single words that return elsewhere on a page are none."""
    diagonal = positions - offsets
    order = np.lexsort((positions, diagonal))
    d, p = diagonal[order], positions[order]
    run = np.concatenate([[0], np.cumsum((np.diff(d) != 0) | (np.diff(p) > 2 * w + 2))])
    first = np.searchsorted(run, np.arange(run[-1] + 1))
    last = np.append(first[1:], len(run)) - 1
    out = np.empty(len(order), bool)
    out[order] = (p[last] - p[first] + w >= 2 * w)[run]
    return out


def _passage(item: Item, offsets: np.ndarray, positions: np.ndarray, c: LeakConfig) -> tuple[int, np.ndarray]:
    """(words, page symbols) of the best passage that these matches make.

    Parts of a passage lie near each other; a long empty stretch (an advert, another column) starts a new one. Each part is
    chained by itself, then those that hold some words of the item densely are chained together, however far apart.
    """
    if not len(positions):
        return 0, positions
    breaks = np.flatnonzero(np.diff(positions) > c.gap_symbols) + 1
    chains = []
    for part in np.split(np.arange(len(positions)), breaks):
        chain = part[_increasing(offsets[part], positions[part])]
        chains.append((_words_in(item, offsets[chain], positions[chain], c), chain))
    solid = [chain for words, chain in chains if words >= min(c.part_words, c.least_words * item.n_words)]
    if len(solid) > 1:
        every = np.sort(np.concatenate(solid))
        chain = every[_increasing(offsets[every], positions[every])]
        chains.append((_words_in(item, offsets[chain], positions[chain], c), chain))
    words, chain = max(chains, key=lambda x: x[0])
    return words, np.unique((positions[chain][:, None] + np.arange(c.window)).ravel())


def _words_in(item: Item, o: np.ndarray, p: np.ndarray, c: LeakConfig) -> int:
    """Words of the item that a chain of windows (offsets o in the item, p on the page) holds densely."""
    w = c.window
    covered = np.zeros(len(item.symbols) + 1, np.int64)
    np.add.at(covered, o, 1)
    np.add.at(covered, o + w, -1)
    covered = np.cumsum(covered[:-1]) > 0
    # Misread letters: a short hole between matches on (nearly) one diagonal counts as matched.
    hole = o[1:] - (o[:-1] + w)
    for a in np.flatnonzero((hole > 0) & (hole <= w + 2) & (np.abs(np.diff(p) - np.diff(o)) <= 2)):
        covered[o[a] + w:o[a + 1]] = True
    return _dense_words(item, covered, c.density)


def _dense_words(item: Item, covered: np.ndarray, density: float) -> int:
    """Most words of the item matched in one of its stretches that is matched densely enough."""
    n = item.n_words
    letters = np.bincount(item.word, minlength=n)[:n]
    hits = np.bincount(item.word, weights=covered, minlength=n)[:n]
    seen = (hits >= 0.6 * letters) & (letters > 0)
    # Largest stretch of words whose matched share stays at the density: a sum of seen - density that rises.
    score = np.concatenate([[0.0], np.cumsum(np.where(seen, 1 - density, -density))])
    total = np.concatenate([[0], np.cumsum(seen)])
    best = 0
    lowest = np.minimum.accumulate(score)
    for end in range(n, 0, -1):
        if total[end] <= best:
            break
        start = int(np.searchsorted(-lowest, -score[end] - 1e-9, "left"))
        if start < end:
            best = max(best, int(total[end] - total[start]))
    return best


def find_leaks(pages: pd.DataFrame, items: list[Item], c: LeakConfig) -> Iterator[tuple]:
    """(doc_id, item_id, words, item words, spans) over pages with columns doc_id, text, x0, x1, y0."""
    if not len(pages):
        return
    streams = page_streams(list(pages["text"]), list(zip(pages["x0"], pages["x1"], pages["y0"], strict=True)))
    ids = pages["doc_id"].tolist()
    telling, first, owners, need = _telling(items, c)
    if not len(telling):
        return
    patterns = np.stack([(telling >> (5 * (c.window - 1 - j))) & 31 for j in range(c.window)], axis=1)
    # Pieces of at most a shard's symbols; a page that is longer than a shard goes in pieces that share a window.
    pieces: list[tuple[int, np.ndarray]] = []
    step = c.shard_symbols - c.window + 1
    for k, (s, _) in enumerate(streams):
        for at in range(0, max(len(s) - c.window + 1, 1), step):
            pieces.append((k, s[at:at + c.shard_symbols]))
    start, kept = 0, np.empty(0, np.int64)
    while start < len(pieces):
        end, total = start, 0
        while end < len(pieces) and (end == start or total + len(pieces[end][1]) + 1 <= c.shard_symbols):
            total += len(pieces[end][1]) + 1
            end += 1
        shard = pieces[start:end]
        lengths = np.array([len(s) + 1 for _, s in shard])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        # A symbol stands between two pages; windows across it are dropped below.
        text = np.full(bounds[-1], 31, np.uint8)
        for (_, s), at in zip(shard, bounds, strict=False):
            text[at:at + len(s)] = s
        index = FMIndex(text)
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        reps = (hi - lo)[hit]
        rows = np.repeat(lo[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at = index.locate(rows)
        window = np.repeat(hit, reps)
        piece = np.searchsorted(bounds, at, side="right") - 1
        inside = at + c.window <= bounds[piece] + lengths[piece] - 1
        page = np.array([k for k, _ in shard])[piece[inside]]
        # Distinct windows by page; those of a page that goes on in the next shard wait for the rest of it.
        kept = np.unique(np.concatenate([kept, page * len(telling) + window[inside]]))
        start = end
        whole = kept // len(telling) != pieces[start][0] if start < len(pieces) else np.ones(len(kept), bool)
        pairs, kept = kept[whole], kept[~whole]
        for k, i in _candidates(pairs // len(telling), pairs % len(telling), first, owners, need):
            item = items[i]
            found = check_item(item, streams[k][0], c)
            if found and found[0] >= c.least_words * item.n_words:
                yield ids[k], item.item_id, found[0], item.n_words, _spans(streams[k][1], found[1])


def _candidates(page: np.ndarray, window: np.ndarray, first: np.ndarray, owners: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int]]:
    """(page, item) with as many of the item's windows as it needs; counted sparsely, in blocks, as a window may have many owners."""
    n_owners = first[window + 1] - first[window]
    ends = np.cumsum(n_owners)
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(window):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
        n = n_owners[at:stop]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, count = np.unique(np.repeat(page[at:stop], n) * len(need) + owners[np.repeat(first[window[at:stop]], n) + inner], return_counts=True)
        keys.append(key)
        counts.append(count)
        at = stop
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(which, weights=np.concatenate(counts), minlength=len(key))
    for x in key[count >= need[key % len(need)]]:
        yield int(x // len(need)), int(x % len(need))


def _telling(items: list[Item], c: LeakConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Searched windows, where the owners of each begin (and the last ends), the owners, and the hits that make each item a candidate.

    An item's windows that more than shared_by items have are left out, as they would make pages of the same turns of phrase
    candidates. Where they are so many that a page may leak the item by them alone, all windows of the item are searched.
    """
    each = [np.unique(i.codes) for i in items]
    n_all = np.array([len(e) for e in each], np.int64)
    codes = np.concatenate([*each, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(items)), n_all)
    order = np.lexsort((owner, codes))
    codes, owner = codes[order], owner[order]
    _, which, n = np.unique(codes, return_inverse=True, return_counts=True)
    few = n[which] <= c.shared_by
    left_out = np.bincount(owner[~few], minlength=len(items))
    whole = left_out >= c.least_words * n_all
    left_out[whole] = 0
    kept = few | whole[owner]
    telling, first = np.unique(codes[kept], return_index=True)
    need = np.maximum(c.least_windows * (n_all - left_out), np.minimum(3, n_all))
    return telling, np.append(first, kept.sum()), owner[kept], need


def _spans(origin: np.ndarray, matched: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the page's text that hold matched symbols; holes of up to 12 code points are closed."""
    matched = matched[matched < len(origin)]
    at = np.sort(origin[matched])
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 12) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cut)]


def leaks(documents: DataFrame, eval_items: DataFrame, c: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, words_found, item_words, span_starts, span_ends): pages with at least half of an item.

    The items are read to the driver and sent to the tasks; they are a fixed test set, refused above 200,000 rows.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    rows = eval_items.where("text is not null and item_id is not null").select("item_id", "text").distinct().orderBy("item_id", "text").limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("the held-out set is too large to be sent to every task")
    ids: dict[str, list[int]] = {}
    for r in rows:
        ids.setdefault(r["text"], []).append(r["item_id"])
    sent = spark.sparkContext.broadcast(list(ids.items()))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [Item(k, t, c.window) for k, (t, _) in enumerate(sent.value)]  # equal texts are one item, reported under each id
        for f in frames:
            found = [(d, i, w, n, [a for a, _ in s], [b for _, b in s]) for d, k, w, n, s in find_leaks(f, items, c) for i in sent.value[k][1]]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "words_found", "item_words", "span_starts", "span_ends"])

    # Pages are searched where they are read, so a newspaper that holds a third of all rows is like any other.
    pages = documents.where("text is not null and doc_id is not null").select("doc_id", "text", *(F.col("lines")[k].alias(k) for k in ("x0", "x1", "y0")))
    return runtime.spread(pages).mapInPandas(search, "doc_id long, item_id long, words_found int, item_words int, span_starts array<long>, span_ends array<long>")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal spans of every page: the matched stretches of all its leaked items, merged."""
    found = leaks(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "eval_items"))
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("span_starts").alias("s"), F.col("span_ends").alias("e")))))
    merge = F.aggregate(
        "spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    per_page = found.groupBy("doc_id").agg(spans.alias("spans"), F.countDistinct("item_id").cast("int").alias("n_items"))
    return per_page.select("doc_id", "n_items", F.explode(merge).alias("x")).select("doc_id", "n_items", F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos"))
