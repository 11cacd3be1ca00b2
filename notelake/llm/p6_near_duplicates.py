"""Problem 6: near-duplicate notes and chunks by circulant MinHash, banding and exact verification.

Exact copies are folded into classes first. Each class gets a signature from two permutations of a
finite domain: the first scatters the shingles, the second, circularly shifted by k, gives coordinate k.
Bands of coordinates are joined; candidates are verified exactly on their shingle sets. Buckets are
joined, not collected, so AQE splits a hot one; singletons are dropped by a partial aggregation first.

Result for pairs: every pair of similar different texts is kept. Copies are linked to their class's
representative (smallest id), and the members of two similar classes to the other's representative.

Null texts, and texts below the size limit, take no part; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import runtime
from notelake.functions.text_size import size_of
from notelake.llm import shingles


# The blank code points of the size estimate, and U+3000.
BLANKS = " \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000\t\n\x0b\x0c\r\x85\u2028\u2029"


@dataclass(frozen=True)
class NearDuplicateConfig:
    width: int = 8            # code points per shingle
    threshold: float = 0.6    # Jaccard similarity of shingle sets
    least_size: int = 80      # smallest size estimate that takes part
    bands: int = 36
    rows: int = 5             # coordinates per band; a pair at 0.6 meets with 0.95, at 0.7 with 0.999
    domain_bits: int = 18
    seed: int = 20_240_611


def circulant_signatures(sets: list[np.ndarray], c: NearDuplicateConfig) -> np.ndarray:
    """(len(sets), bands * rows) coordinates: min over s of pi[(sigma(s) + k) mod D]. No set may be empty."""
    size, k = 1 << c.domain_bits, c.bands * c.rows
    pi = np.random.default_rng(c.seed).permutation(size).astype(np.int32)
    # Row s of the view is pi at s, s + 1, ..., s + k - 1: all shifts of one shingle lie side by side in memory.
    shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)
    out = np.empty((len(sets), k), np.int32)
    for i, s in enumerate(sets):
        # sigma: shingle hashes are uniform, so their low bits already scatter them over the domain.
        at = (s & np.uint64(size - 1)).astype(np.intp)
        low = shifts[at[:2048]].min(axis=0)
        for start in range(2048, len(at), 2048):
            np.minimum(low, shifts[at[start:start + 2048]].min(axis=0), out=low)
        out[i] = low
    return out


def band_hashes(signatures: np.ndarray, c: NearDuplicateConfig) -> np.ndarray:
    """(n, bands) 64-bit hashes, different for equal rows in different bands."""
    s = signatures.astype(np.uint64).reshape(len(signatures), c.bands, c.rows)
    h = np.broadcast_to(np.arange(1, c.bands + 1, dtype=np.uint64), (len(s), c.bands)).copy()
    for j in range(c.rows):
        h = shingles.mix(h * shingles.PRIME + s[:, :, j])
    return h.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """(n, words) of the coordinates' lowest bits, 64 to a word."""
    n, k = signatures.shape
    bits = np.zeros((n, -(-k // 64) * 64), np.uint8)
    bits[:, :k] = signatures & 1
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def _most_differing(c: NearDuplicateConfig) -> int:
    """Sketch bits that a pair at the threshold exceeds with a chance below 0.001."""
    k = c.bands * c.rows
    p = (1 - c.threshold) / 2
    return int(k * p + 3.2 * (k * p * (1 - p)) ** 0.5) + 1


def similar_texts(texts: DataFrame, c: NearDuplicateConfig = NearDuplicateConfig()) -> DataFrame:
    """texts(text_id LONG unique, kind STRING, content) -> (id_a, id_b, similarity), id_a < id_b, one kind."""
    spark = texts.sparkSession
    runtime.ship(spark)
    words = -(-c.bands * c.rows // 64)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2000):
                g = f.iloc[at:at + 2000]
                sets = [shingles.shingle_set(t, c.width) for t in g["content"]]
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                signatures = circulant_signatures([sets[i] for i in keep], c)
                yield pd.DataFrame({
                    "text_id": g["text_id"].to_numpy()[keep], "kind": g["kind"].to_numpy()[keep],
                    "bands": list(band_hashes(signatures, c).astype(np.int32)), "sketch": list(sketches(signatures)),
                })

    signed = runtime.cut(
        texts.mapInPandas(sign, "text_id long, kind string, bands array<int>, sketch array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    # 32-bit band hashes and dense row numbers keep the one large shuffle small; hashes that meet by chance are verified away.
    rows = signed.select("row", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    sketch = signed.select("row", "text_id", "kind", "sketch")
    members = runtime.cut(rows.join(shared, "band", "left_semi").join(sketch, "row").drop("row"))
    a, b = members.alias("a"), members.alias("b")
    differing = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(words)), F.lit(0))
    candidates = runtime.cut(
        a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.text_id") < F.col("b.text_id")))
        .where(differing <= _most_differing(c))
        .select(F.col("a.text_id").alias("id_a"), F.col("b.text_id").alias("id_b")).distinct()
    )
    wanted = candidates.select(F.col("id_a").alias("text_id")).union(candidates.select("id_b")).distinct()
    some = runtime.cut(texts.select("text_id", "content").join(wanted, "text_id", "left_semi"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last, first = None, None
            found = []
            for ia, ib, ta, tb in zip(f["id_a"], f["id_b"], f["text_a"], f["text_b"], strict=True):
                if last != ia:
                    last, first = ia, shingles.shingle_set(ta, c.width)
                s = shingles.jaccard(first, shingles.shingle_set(tb, c.width))
                if s >= c.threshold:
                    found.append((ia, ib, s))
            yield pd.DataFrame(found, columns=["id_a", "id_b", "similarity"])

    joined = (
        candidates.join(some.select(F.col("text_id").alias("id_b"), F.col("content").alias("text_b")), "id_b")
        .join(some.select(F.col("text_id").alias("id_a"), F.col("content").alias("text_a")), "id_a")
    )
    return joined.mapInPandas(verify, "id_a long, id_b long, similarity double")


def _taking_part(notes: DataFrame, chunks: DataFrame, c: NearDuplicateConfig) -> tuple[DataFrame, DataFrame]:
    """Members (item_kind, item_id, text_id), one row per item, and texts (text_id, kind, content), one per text.

    Texts are named by a hash before any shuffle, so the contents themselves move once.
    """
    states = notes.where("note_id is not null").select(
        F.lit("note").alias("item_kind"), F.col("note_id").cast("string").alias("item_id"), "content",
        F.coalesce(F.col("updated_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"),
    ).unionByName(chunks.where("chunk_id is not null").select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "content", F.lit("0001-01-01").cast("timestamp").alias("at"),
    ))
    # A size is at most the length and at least a quarter of the code points that are not blank; only between it is counted.
    text = F.col("content")
    visible = F.length(F.translate(text, BLANKS, ""))
    large = F.when(F.length(text) < c.least_size, F.lit(False)).when(visible >= 4 * c.least_size, F.lit(True)).otherwise(size_of(text) >= c.least_size)
    states = states.where("content is not null").withColumn("text_id", F.xxhash64("item_kind", F.sha2("content", 256)))
    latest = states.groupBy("item_kind", "item_id").agg(F.max(F.struct("at", "text_id")).alias("s"))
    texts = runtime.cut(states.where(large).groupBy("text_id").agg(F.first("item_kind").alias("kind"), F.first("content").alias("content")))
    members = latest.select("item_kind", "item_id", F.col("s.text_id").alias("text_id")).join(texts.select("text_id"), "text_id", "left_semi")
    return runtime.cut(members), texts


def _before(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "note", a.cast("long") < b.cast("long")).otherwise(a < b)


def _representative() -> Column:
    """Smallest id: notes as numbers, chunks as strings."""
    return F.when(
        F.first("item_kind") == "note", F.min(F.when(F.col("item_kind") == "note", F.col("item_id").cast("long"))).cast("string")
    ).otherwise(F.min("item_id")).alias("rep")


def near_duplicate_pairs(notes: DataFrame, chunks: DataFrame, c: NearDuplicateConfig = NearDuplicateConfig()) -> DataFrame:
    """(item_kind, item_id_a, item_id_b) of similar notes and of similar chunks."""
    ids, texts = _taking_part(notes, chunks, c)
    pairs = runtime.cut(similar_texts(texts, c))
    reps = ids.groupBy("text_id").agg(_representative())
    copies = ids.join(reps, "text_id").where("item_id <> rep").select("item_kind", F.col("item_id").alias("x"), F.col("rep").alias("y"))
    both = pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a")).toDF("text_id", "other")
    across = (
        both.join(reps.withColumnRenamed("text_id", "other"), "other").join(ids, "text_id")
        .select("item_kind", F.col("item_id").alias("x"), F.col("rep").alias("y"))
    )
    a_first = _before(F.col("item_kind"), F.col("x"), F.col("y"))
    return (
        copies.unionByName(across)
        .select("item_kind", F.when(a_first, F.col("x")).otherwise(F.col("y")).alias("item_id_a"), F.when(a_first, F.col("y")).otherwise(F.col("x")).alias("item_id_b"))
        .distinct()
    )


def components(links: DataFrame, ids: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b), ids(id) -> (id, group_id): the smallest id reachable. Alternating star contraction.

    The number of rounds grows with the logarithm of the largest component; each round's links are
    written to the shared folder. Nothing is gathered but the count of changed links.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = runtime.cut(edges)
    for _ in range(most_rounds):
        # Large star: link every larger neighbour to the smallest neighbour.
        both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: link every smaller neighbour, and the node, to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = runtime.cut(small)
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "id")
    return ids.join(roots, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def near_duplicate_groups(notes: DataFrame, chunks: DataFrame, c: NearDuplicateConfig = NearDuplicateConfig()) -> DataFrame:
    """(item_kind, item_id, group_id STRING, n_links): one row per item that takes part.

    n_links counts the similar different texts; copies share the row's group. group_id names a class of texts.
    """
    members, texts = _taking_part(notes, chunks, c)
    pairs = runtime.cut(similar_texts(texts, c))
    group = components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), members.select(F.col("text_id").alias("id")).distinct())
    degree = pairs.select("id_a").union(pairs.select("id_b")).toDF("id").groupBy("id").agg(F.count("*").alias("n_links"))
    labelled = group.join(degree, "id", "left").select(F.col("id").alias("text_id"), F.hex("group_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.select("text_id", "item_kind", "item_id").join(labelled, "text_id").drop("text_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(runtime.read(spark, sf_dir, "notes"), runtime.read(spark, sf_dir, "chunks"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(runtime.read(spark, sf_dir, "notes"), runtime.read(spark, sf_dir, "chunks"))
