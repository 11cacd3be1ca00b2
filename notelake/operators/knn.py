"""Exact and approximate nearest vectors behind one call.

Scores are rounded to twelve places, so that equal vectors tie whatever the order of summation; ties go to the smaller
id everywhere, before every cut. Queries travel to the vectors, never the other way, `block` of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake import runtime
from notelake.functions.vector import checked, dot, l2_normalize, norm
from notelake.operators import hnsw_file
from notelake.operators.hnsw import HNSWConfig

#: An inverted file's query probes one in so many cells, 16 at least.
IVF_SHARE = 8
#: Vectors per bucket of a table of hyperplanes, about.
LSH_BUCKET = 300

RESULT = "query_id string, id string, score double"


def score_of():
    return F.round(dot(F.col("vec"), F.col("qvec")), 12)


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, id_column: str = "id") -> DataFrame:
    """Rows of the k best scores, per group if any; adds rank from 1. k <= 0: none. NaN and null scores are left out."""
    scored = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.desc("score"), F.col(id_column)]
    if k <= 0:
        return scored.withColumn("rank", F.lit(0)).limit(0)
    if not by:
        best = scored.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def score_single(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vectors(id, vec) against the one row of query(qvec) -> (id, score)."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("id", score_of().alias("score"))


def knn_expression(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores by expressions only; for few queries."""
    pairs = vectors.crossJoin(F.broadcast(queries))
    return top_k(pairs.select("query_id", "id", score_of().alias("score")), k, ["query_id"])


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest numbers of each row, best first; of equal ones the lower column."""
    k = min(k, s.shape[1])
    t = np.where(np.isnan(s), -np.inf, s)
    least = np.partition(t, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    r, j = np.nonzero(t >= least[:, None])
    order = np.lexsort((j, -t[r, j], r))
    r, j = r[order], j[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(s)))[r] < k
    return r[keep], j[keep]


def _query_blocks(queries: DataFrame, dimension: int, block: int, vec=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the queries, a block at a time, so any number of them."""
    vec = checked(F.col("qvec"), dimension) if vec is None else vec
    asked = queries.select("query_id", vec.alias("qvec")).orderBy("query_id").toLocalIterator()
    while rows := list(islice(asked, block)):
        yield np.array([r["query_id"] for r in rows], object), np.array([r["qvec"] for r in rows], np.float64).reshape(len(rows), dimension)


def _few(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows such that a product with `width` columns has about four million numbers at most."""
    step = max(1, 4_000_000 // max(width, 1))
    return (slice(a, a + step) for a in range(0, n, step))


def knn_matrix(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, block: int = 20_000) -> DataFrame:
    """Scores by matrix products per Arrow batch; each task keeps its k best, which are merged."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    if k <= 0:
        return spark.createDataFrame([], RESULT).withColumn("rank", F.lit(0))

    def search_for(sent):
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for f in frames:
                if not len(f):
                    continue
                f = f.sort_values("id", kind="stable")
                x, names = np.stack(f["vec"].to_numpy()).astype(np.float64), f["id"].to_numpy()
                for part in _few(len(q), len(x)):
                    s = np.round(q[part] @ x.T, 12)
                    r, j = best_of(s, k)
                    yield pd.DataFrame({"query_id": ids[part][r], "id": names[j], "score": s[r, j]})

        return search

    kept = vectors.select(F.col("id").cast("string").alias("id"), checked(F.col("vec"), dimension).alias("vec"))
    found = spark.createDataFrame([], RESULT)
    for sent in _query_blocks(queries, dimension, block):
        found = found.unionByName(kept.mapInPandas(search_for(spark.sparkContext.broadcast(sent)), RESULT))
    return top_k(found, k, ["query_id"])


def best_groups(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, block: int = 20_000) -> DataFrame:
    """vectors(id, group LONG, vec) -> (query_id, group, score): the k groups with the best single vector.

    A group among the k best is among the k best of the batch that holds its best vector, so k per batch suffice.
    """
    spark = vectors.sparkSession
    runtime.ship(spark)

    def search_for(sent):
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for f in frames:
                if not len(f):
                    continue
                f = f.sort_values("group", kind="stable")
                group, first = np.unique(f["group"].to_numpy(), return_index=True)
                x = np.stack(f["vec"].to_numpy()).astype(np.float64)
                for part in _few(len(q), len(x)):
                    s = np.maximum.reduceat(np.round(q[part] @ x.T, 12), first, axis=1)
                    r, j = best_of(s, k)
                    yield pd.DataFrame({"query_id": ids[part][r], "group": group[j], "score": s[r, j]})

        return search

    kept = vectors.select("group", checked(F.col("vec"), dimension).alias("vec"))
    found = spark.createDataFrame([], "query_id string, group long, score double")
    for sent in _query_blocks(queries, dimension, block):
        found = found.unionByName(kept.mapInPandas(search_for(spark.sparkContext.broadcast(sent)), "query_id string, group long, score double"))
    return top_k(found.groupBy("query_id", "group").agg(F.max("score").alias("score")), k, ["query_id"], "group")


def fit_cells(vectors: DataFrame, n: int, cells: int, dimension: int, sample: int = 20_000, seed: int = 17) -> np.ndarray:
    """Centres of an inverted file over n vectors, fitted on at most twice `sample` of them, taken by hash."""
    every = max(1, -(-n // sample))
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vec").limit(2 * sample).collect()
    x = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), dimension)
    if not len(x):
        return np.zeros((1, dimension))
    rng = np.random.default_rng(seed)
    m = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(10):
        near = np.concatenate([(x[a:a + 4096] @ m.T - 0.5 * (m * m).sum(axis=1)).argmax(axis=1) for a in range(0, len(x), 4096)])
        total, count = np.zeros_like(m), np.bincount(near, minlength=len(m))
        np.add.at(total, near, x)
        m = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], m)
    return m


def _long_above(vectors: DataFrame) -> float:
    """The norm above which a vector is long: it may win by its length, whatever its direction, so cells and buckets don't hold it."""
    n = vectors.select(norm(F.col("vec")).alias("n")).where("n > 0").agg(F.percentile_approx("n", 0.5, 10_000)).first()[0]
    return 1.1 * (n or 0.0)


def _filled(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries that met fewer than k vectors are searched exactly."""
    found = runtime.cut(found)
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    rest = knn_expression(vectors, queries.join(full, "query_id", "left_anti"), k)
    return found.join(full, "query_id", "left_semi").unionByName(rest.select("query_id", F.col("id").cast("string").alias("id"), "score", "rank"))


Met = Iterator[tuple[np.ndarray, np.ndarray]]


def _grouped(values: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """rows by value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return {int(values[p[0]]): rows[p] for p in np.split(order, cuts)} if len(values) else {}


def ivf_meetings(x: np.ndarray, q: np.ndarray, m: np.ndarray, probes: int, long_above: float) -> Met:
    """(rows of q, rows of x) that meet: queries and vectors of the `probes` cells nearest to each query, and all queries and long vectors."""
    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=v.copy(), where=n > 0)

    offset, long = 0.5 * (m * m).sum(axis=1), np.linalg.norm(x, axis=1) > long_above
    short = np.flatnonzero(~long)
    held = _grouped((unit(x[short]) @ m.T - offset).argmax(axis=1), short)
    probes = min(probes, len(m))
    asked = np.argsort(offset - unit(q) @ m.T, axis=1, kind="stable")[:, :probes]
    for cell, rows in _grouped(asked.ravel(), np.repeat(np.arange(len(q)), probes)).items():
        if cell in held:
            yield rows, held[cell]
    if long.any():
        yield np.arange(len(q)), np.flatnonzero(long)


def knn_ivf(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, cells: int | None = None, probes: int | None = None, block: int = 20_000) -> DataFrame:
    """A query meets the vectors whose directions lie in its nearest cells, and all long ones.

    The cells grow with the square root of the number of vectors, so a query meets a falling share of them.
    """
    runtime.ship(vectors.sparkSession)
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], RESULT).withColumn("rank", F.lit(0))
    n, long_above = vectors.count(), _long_above(vectors)
    cells = cells or max(16, round(n ** 0.5))
    m = fit_cells(vectors.where(norm(F.col("vec")) <= long_above).select("id", l2_normalize(F.col("vec")).alias("vec")), n, cells, dimension)
    return _best_met(vectors, queries, k, dimension, lambda x, q: ivf_meetings(x, q, m, probes or max(16, len(m) // IVF_SHARE), long_above), block)


def lsh_meetings(x: np.ndarray, q: np.ndarray, planes: np.ndarray, probes: int, long_above: float) -> Met:
    """(rows of q, rows of x) that meet: vectors in a query's `probes` likeliest buckets of each table, and all queries and long vectors.

    The likeliest other buckets are those across the planes that the query lies nearest to.
    """
    tables, bits, dimension = planes.shape
    weight = 1 << np.arange(bits)
    long = np.linalg.norm(x, axis=1) > long_above
    short = np.flatnonzero(~long)
    flips = min(bits, max(1, int(probes).bit_length() + 2))  # of the planes nearest to the query; others are crossed later
    sides = (np.arange(1 << flips)[:, None] >> np.arange(flips)) & 1
    for t in range(tables):
        held = _grouped((x[short] @ planes[t].T > 0) @ weight, short)
        at = q @ planes[t].T
        near = np.argsort(np.abs(at), axis=1, kind="stable")[:, :flips]
        cost = np.take_along_axis(at ** 2, near, 1) @ sides.T
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        crossed = (sides[order] * weight[near][:, None, :]).sum(axis=2)
        bucket = ((at > 0) @ weight)[:, None] ^ crossed
        for b, rows in _grouped(bucket.ravel(), np.repeat(np.arange(len(q)), bucket.shape[1])).items():
            if b in held:
                yield rows, held[b]
    if long.any():
        yield np.arange(len(q)), np.flatnonzero(long)


def _best_met(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, meet: Callable[[np.ndarray, np.ndarray], Met], block: int) -> DataFrame:
    """The k best of the vectors that each query meets; only these are scored. meet(x, q): rows of q and rows of x that meet."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("id").cast("string").alias("id"), checked(F.col("vec"), dimension).alias("vec"))

    def search_for(sent):
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for f in frames:
                if not len(f):
                    continue
                f = f.sort_values("id", kind="stable")
                x, names = np.stack(f["vec"].to_numpy()).astype(np.float64), f["id"].to_numpy()
                pairs, scores = [np.empty(0, np.int64)], [np.empty(0)]
                for a, b in meet(x, q):
                    for part in _few(len(a), len(b)):
                        s = np.round(q[a[part]] @ x[b].T, 12)
                        r, j = best_of(s, k)
                        pairs.append(a[part][r] * len(x) + b[j])
                        scores.append(s[r, j])
                met, first = np.unique(np.concatenate(pairs), return_index=True)  # tables of buckets may meet twice
                s, a, b = np.concatenate(scores)[first], met // len(x), met % len(x)
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                keep = np.arange(len(a)) - np.searchsorted(a, np.arange(len(q)))[a] < k
                yield pd.DataFrame({"query_id": ids[a[keep]], "id": names[b[keep]], "score": s[keep]})

        return search

    found = spark.createDataFrame([], RESULT)
    for sent in _query_blocks(queries, dimension, block):
        found = found.unionByName(kept.mapInPandas(search_for(spark.sparkContext.broadcast(sent)), RESULT))
    return _filled(top_k(found, k, ["query_id"]), vectors, queries, k)


def knn_lsh(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, tables: int = 16, bits: int | None = None, seed: int = 23, probes: int | None = None, block: int = 20_000) -> DataFrame:
    """Random hyperplanes: a query meets the vectors of its likeliest buckets in any table, and all long ones.

    The bits grow with the logarithm of the number of vectors, so buckets stay as large; the probes grow with the bits.
    """
    runtime.ship(vectors.sparkSession)
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], RESULT).withColumn("rank", F.lit(0))
    bits = bits or lsh_bits(vectors.count())
    planes, long_above = np.random.default_rng(seed).normal(size=(tables, bits, dimension)), _long_above(vectors)
    return _best_met(vectors, queries, k, dimension, lambda x, q: lsh_meetings(x, q, planes, probes or lsh_probes(bits), long_above), block)


def lsh_bits(n: int) -> int:
    return min(24, max(6, round(np.log2(max(n, 1) / LSH_BUCKET))))


def lsh_probes(bits: int) -> int:
    return 6 + 3 * (bits - 6)


def knn_hnsw(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, shard_rows: int = 20_000, config: HNSWConfig = HNSWConfig(), block: int = 20_000) -> DataFrame:
    """One graph per hash shard of unit vectors; every query searches every shard, and the shards' results are merged.

    The graphs are built once and kept as files in the shared folder; each block of queries searches them there.
    """
    spark = vectors.sparkSession
    runtime.ship(spark)
    if k <= 0:
        return spark.createDataFrame([], RESULT).withColumn("rank", F.lit(0))
    index = hnsw_file.build(vectors.select(F.col("id").cast("string").alias("id"), l2_normalize(checked(F.col("vec"), dimension)).alias("vec")), shard_rows, config)
    found = spark.createDataFrame([], RESULT)
    for sent in _query_blocks(queries, dimension, block, l2_normalize(checked(F.col("qvec"), dimension))):
        found = found.unionByName(hnsw_file.search(index, spark.sparkContext.broadcast(sent), k, config))
    return top_k(found, k, ["query_id"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, strategy: str = "exact") -> DataFrame:
    """vectors(id, vec), queries(query_id, qvec) -> (query_id, id, score, rank)."""
    if strategy == "exact":
        return knn_matrix(vectors, queries, k, dimension)
    if strategy == "expression":
        return knn_expression(vectors, queries, k)
    return {"ivf": knn_ivf, "lsh": knn_lsh, "hnsw": knn_hnsw}[strategy](vectors, queries, k, dimension)


def upsert(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """vectors(id, vec, version) with changes of the same shape: the highest version of an id wins."""
    return latest(vectors.unionByName(changes))


def latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("id").agg(F.max(F.struct("version", "vec")).alias("s")).select("id", "s.vec", "s.version")


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the ids; unknown ids do nothing."""
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def remove_all(vectors: DataFrame) -> DataFrame:
    return vectors.limit(0)


def must_compact(live, deleted):
    """The policy by which an index with tombstones is rewritten; of numbers or of columns."""
    return (deleted > 64) & (2 * deleted > live)
