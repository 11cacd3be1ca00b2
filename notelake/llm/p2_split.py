"""Problem 2: splitting oversized items by content-defined chunking.

A rolling hash over 16 code points marks landmarks; each snaps to the nearest natural boundary (paragraph before
sentence before blank before grapheme). From the start of a piece the first landmark within the minimum and maximum
size ends it; where there is none, the strongest boundary before the maximum does. As landmarks depend on nearby text
only, an edit changes neighbouring pieces and leaves the others. Consecutive pieces share the text before the cut,
from a boundary on, up to the overlap; the limit holds for the piece with its overlap.

Null texts and texts within the limit give no pieces. A grapheme larger than the limit is cut inside. Copies of an
item count once; further columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import runtime
from notelake.functions.text_size import CJK_RANGES, size_of
from notelake.llm import shingles
from notelake.llm.tables import items_of


@dataclass(frozen=True)
class SplitConfig:
    limit: int = 400       # largest size of a piece with its overlap
    overlap: int = 50      # largest size shared with the piece before
    least: int = 200       # smallest size at which a landmark ends a piece
    window: int = 16       # code points of the rolling hash
    mask_bits: int = 6     # one landmark in 2 ** mask_bits positions
    snap: int = 80         # code points within which a landmark looks for a boundary


# Terminators and closing marks after which a sentence may end.
TERMINATORS = ".!?。！？．｡…؟۔।"
CLOSERS = ")]}\"'”’»」』）】"
LINE_ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: kind (0 visible, 1 CJK, 2 blank) and sign bits (1 line end, 2 blank, 4 terminator, 8 closer, 16 joins the one before)."""
    kind, sign = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Zs" or ch == "\t" or ch in LINE_ENDS:
            kind[cp], sign[cp] = 2, 2
        if cat in ("Mn", "Mc", "Me") or cp in (0x200C, 0x200D) or 0xFE00 <= cp <= 0xFE0F:
            sign[cp] |= 16
    for a, b in CJK_RANGES:
        kind[a:b + 1] = 1
    for ch in LINE_ENDS:
        sign[ord(ch)] |= 1
    for ch in TERMINATORS:
        sign[ord(ch)] |= 4
    for ch in CLOSERS:
        sign[ord(ch)] |= 8
    return kind, sign


class _Sizes:
    """Sizes of stretches of a text, from running counts."""

    def __init__(self, cps: np.ndarray) -> None:
        kind = _tables()[0][np.minimum(cps, 0xFFFF)]
        kind = np.where(cps > 0xFFFF, 0, kind)
        self.cjk = np.concatenate([[0], np.cumsum(kind == 1)])
        self.other = np.concatenate([[0], np.cumsum(kind == 0)])

    def of(self, a, b):
        return self.cjk[b] - self.cjk[a] + (self.other[b] - self.other[a] + 3) // 4

    def furthest(self, a: int, limit: int) -> int:
        """Largest b with of(a, b) <= limit."""
        lo, hi = a, len(self.cjk) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.of(a, mid) <= limit:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def earliest(self, b: int, limit: int) -> int:
        """Smallest a with of(a, b) <= limit."""
        lo, hi = 0, b
        while lo < hi:
            mid = (lo + hi) // 2
            if self.of(mid, b) <= limit:
                hi = mid
            else:
                lo = mid + 1
        return lo


def boundary_ranks(cps: np.ndarray) -> np.ndarray:
    """For each position 0..n: 4 before a paragraph, 3 a sentence, 2 a word, 1 a grapheme, 0 inside one."""
    kind, signs = _tables()
    at = np.minimum(cps, 0xFFFF)
    sign = signs[at]
    cjk = kind[at] == 1
    n = len(cps)
    rank = np.ones(n + 1, np.uint8)
    if n < 2:
        return rank
    before, after = sign[:-1], sign[1:]
    inner = rank[1:n]
    blank_before, blank_after = before & 2 > 0, after & 2 > 0
    inner[(blank_before & ~blank_after) | (cjk[:-1] & ~(sign[1:] & 12 > 0))] = 2
    # A sentence ends after a terminator and its closers, before a blank; in CJK right there.
    ended = before & 4 > 0
    for _ in range(3):
        follows = np.concatenate([[False], ended[:-1]]) & (before & 8 > 0)
        ended = ended | follows
    run = ended & ~(after & 12 > 0)
    inner[run & cjk[:-1]] = 3
    past = np.concatenate([[False], ended])
    for _ in range(3):
        past = past | np.concatenate([[False], past[:-1] & (sign[:-1] & 2 > 0)])
    inner[past[1:] & blank_before & ~blank_after] = 3 if len(inner) else 0
    line = np.concatenate([[False], (sign[:-1] & 1) > 0]) if n else np.empty(0, bool)
    for _ in range(3):
        line = line | np.concatenate([[False], line[:-1] & (sign[:-1] & 2 > 0)])
    inner[line[1:] & ~blank_after] = 4
    inner[(after & 16 > 0) | (cps[:-1] == 0x200D) | ((cps[:-1] == 13) & (cps[1:] == 10))] = 0
    return rank


def landmarks(cps: np.ndarray, rank: np.ndarray, c: SplitConfig) -> np.ndarray:
    """Sorted positions of landmarks, each moved to the strongest, then nearest boundary within reach."""
    h = shingles.window_hashes(cps, c.window)
    marks = np.flatnonzero((h & np.uint64((1 << c.mask_bits) - 1)) == 0) + c.window // 2
    out = set()
    n = len(cps)
    for m in marks.tolist():
        lo, hi = max(1, m - c.snap), min(n, m + c.snap + 1)
        r = rank[lo:hi]
        if not len(r):
            continue
        best = r.max()
        if best < 2:
            continue
        near = np.flatnonzero(r == best) + lo
        out.add(int(near[np.argmin(np.abs(near - m))]))
    return np.array(sorted(out), np.int64)


def split(text: str, c: SplitConfig = SplitConfig()) -> list[tuple[int, int, int]]:
    """(core start, start with overlap, end) of each piece; cores tile the text. [] within the limit."""
    cps = shingles.code_points(text).astype(np.int64)
    sizes = _Sizes(cps)
    n = len(cps)
    if sizes.of(0, n) <= c.limit:
        return []
    rank = boundary_ranks(cps)
    marks = landmarks(cps, rank, c)
    pieces: list[tuple[int, int, int]] = []
    start = 0
    while start < n:
        begin = start
        if start:
            begin = sizes.earliest(start, c.overlap)
            stretch = rank[begin:start]  # without start itself, which would end the search with no overlap
            for least in (3, 2, 1):
                ok = np.flatnonzero(stretch >= least)
                if len(ok):
                    begin = begin + int(ok[0])
                    break
            else:
                begin = start
        most = sizes.furthest(begin, c.limit)
        if most <= start:  # an overlap that leaves no room
            begin, most = start, max(sizes.furthest(start, c.limit), start + 1)
        if most >= n:
            end = n
        else:
            lowest = min(sizes.furthest(start, c.least - 1) + 1, most)
            k = np.searchsorted(marks, lowest)
            if k < len(marks) and marks[k] <= most:
                end = int(marks[k])
            else:
                stretch = rank[lowest:most + 1]
                end = most
                for least in (4, 3, 2, 1):
                    ok = np.flatnonzero(stretch >= least)
                    if len(ok):
                        end = lowest + int(ok[-1])
                        break
                end = max(end, start + 1)
        pieces.append((start, begin, end))
        start = end
    return pieces


def pieces(items: DataFrame, c: SplitConfig = SplitConfig()) -> DataFrame:
    """items(item_kind, item_id, content) -> (item_kind, item_id, piece_index, start_pos, end_pos, overlap_chars, size, piece)."""
    spark = items.sparkSession
    runtime.ship(spark)
    large = items.where("content is not null and item_id is not null").where(size_of(F.col("content")) > c.limit)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["item_kind", "item_id", "piece_index", "start_pos", "end_pos", "overlap_chars", "size", "piece"]
        for f in frames:
            rows = []
            for kind, key, text in zip(f["item_kind"], f["item_id"], f["content"], strict=True):
                sizes = _Sizes(shingles.code_points(text).astype(np.int64))
                for i, (start, begin, end) in enumerate(split(text, c)):
                    rows.append((kind, key, i, begin, end, start - begin, int(sizes.of(begin, end)), text[begin:end]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    schema = "item_kind string, item_id string, piece_index int, start_pos long, end_pos long, overlap_chars int, size int, piece string"
    return large.mapInPandas(cut, schema)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(items_of(runtime.read(spark, sf_dir, "notes"), runtime.read(spark, sf_dir, "chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct item that had to be split."""
    return p2_pieces(spark, sf_dir).where("piece_index = 0").select("item_kind", "item_id")
