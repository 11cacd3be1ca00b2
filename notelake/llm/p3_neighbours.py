"""Problem 3: the k most similar vectors of every vector, by HNSW graphs per shard with merged results.

Vectors are normalised and folded into classes of equal direction, so copies are compared once; a class carries its k + 1
smallest ids, the only ones of it that can be anyone's neighbours. Shards are the cells of centroids fitted on a bounded
sample, in two levels where they are many. Every class is indexed in the shard of its nearest centroid and searched in
the `probes` nearest at most, and of these only in those nearly as close as the nearest, so work grows with the number of
vectors. A cell beyond twice the shard's size is split by hash, and all its parts are searched; queries beyond a bound go
in blocks. Each task builds one graph as flat arrays, searches it, and scores what it found in double precision. Results
of shards are merged by class and handed to the class's ids: ties go to the smaller id.

Only vectors of the right length with finite numbers, not all zero, and with an id take part; of rows of one id one
vector is used (the one with the larger hash, should they differ). Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake import runtime
from notelake.llm import shingles
from notelake.operators import knn, metrics
from notelake.operators.hnsw import HNSW, HNSWConfig


@dataclass(frozen=True)
class NeighbourConfig:
    k: int = 5
    dimension: int = 64
    shard: int = 30_000          # vectors per shard, about; a cell of twice as many is split
    queries: int = 120_000       # queries of a shard per block, about
    sample: int = 16_000         # vectors that centroids are fitted on, about; 16 per centroid where that is more
    most_sample: int = 400_000   # at most: the bound of what the driver reads
    probes: int = 3              # shards that a vector is searched in, at most
    margin: float = 0.15         # how much less similar than the nearest a searched shard's centroid may be
    flat: int = 256              # centroids up to which there is one level
    rounds: int = 12             # of the centroids' fitting
    graph: HNSWConfig = field(default_factory=lambda: HNSWConfig(m=16, ef_construction=64, ef_search=56))


def vectors_of(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """(id, embedding) of chunks and of reference cases."""
    cases = references.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("id"), F.col("c.embedding").alias("embedding"))
    return chunks.select(F.col("chunk_id").alias("id"), "embedding").unionByName(cases)


def usable(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and these as unit vectors in float32."""
    offsets = column.offsets.to_numpy()
    ok = np.flatnonzero((np.diff(offsets) == d) & column.is_valid().to_numpy(zero_copy_only=False))
    numbers = column.values.to_numpy(zero_copy_only=False)  # null numbers come out as NaN
    x = numbers[offsets[:-1][ok][:, None] + np.arange(d)].astype(np.float64) if len(ok) else np.empty((0, d))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return ok[good], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4") + np.float32(0)


def class_of(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's bits."""
    words = np.ascontiguousarray(x).view("<u4").astype(np.uint64)
    h = np.full(len(x), shingles.PRIME, np.uint64)
    for j in range(words.shape[1]):
        h = shingles.mix(h ^ words[:, j])
    return h.view(np.int64)


def unit_rows(vectors: DataFrame, d: int, with_vectors: bool) -> DataFrame:
    """(id, cls[, vec]) of the usable rows of vectors(id, embedding)."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = usable(b.column("embedding"), d)
            out = {"id": b.column("id").take(pa.array(at)), "cls": pa.array(class_of(x))}
            if with_vectors:
                out["vec"] = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "id string, cls long" + ", vec binary" * with_vectors
    return vectors.where("id is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(unit, schema)


def fit_centroids(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    m = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(x[a:a + 8192] @ m.T).argmax(axis=1) for a in range(0, len(x), 8192)])
        sums = np.zeros_like(m, dtype=np.float64)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        m = np.where(norm > 0, sums / np.maximum(norm, 1e-12), m).astype(np.float32)
    return m


class Cells:
    """Centroids; where they are many, below coarser ones, so that no vector meets all of them."""

    def __init__(self, sample: np.ndarray, k: int, c: NeighbourConfig) -> None:
        self.c = c
        if k <= c.flat:
            self.coarse, self.fine = None, [fit_centroids(sample, k, c.rounds)]
        else:
            self.coarse = fit_centroids(sample, int(np.ceil(k ** 0.5)), c.rounds)
            own = np.concatenate([(sample[a:a + 8192] @ self.coarse.T).argmax(axis=1) for a in range(0, len(sample), 8192)])
            self.fine = [fit_centroids(part, max(1, round(k * len(part) / len(sample))), c.rounds) if len(part) else self.coarse[g:g + 1] for g in range(len(self.coarse)) for part in [sample[own == g]]]
        self.first = np.concatenate([[0], np.cumsum([len(m) for m in self.fine])])
        self.n = int(self.first[-1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, probes) of cells, the nearest first, and whether each is near enough to be searched."""
        p = self.c.probes
        cells, sims = np.zeros((len(x), p), np.int64), np.full((len(x), p), -3, np.float32)
        groups = np.zeros((len(x), 1), int) if self.coarse is None else np.argsort(-(x @ self.coarse.T), axis=1)[:, :p]
        for g, m in enumerate(self.fine):
            rows = np.flatnonzero((groups == g).any(axis=1))
            if not len(rows):
                continue
            s = x[rows] @ m.T
            top = np.argsort(-s, axis=1)[:, :p]
            both = np.concatenate([sims[rows], np.take_along_axis(s, top, 1)], axis=1)
            ids = np.concatenate([cells[rows], self.first[g] + top], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :p]
            sims[rows], cells[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
        return cells, (sims > -2) & (sims >= sims[:, :1] - self.c.margin)


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, d)


def class_neighbours(classes: DataFrame, c: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """classes(cls LONG unique, ids ARRAY<STRING>, vec BINARY unit float32) -> (cls, near ARRAY<STRUCT<s, id>>).

    near has the k + 1 best ids for the class, its own included, by falling similarity (s is its negative).
    """
    spark = classes.sparkSession
    n = classes.count()
    k = max(1, round(n / c.shard))
    wanted = min(c.most_sample, max(c.sample, 16 * k))
    rows = classes.where(F.pmod(F.hash("cls"), F.lit(max(1, -(-n // wanted)))) == 0).select("vec").limit(2 * wanted).collect()
    if not rows:
        rows = classes.select("vec").limit(1).collect()
    d = c.dimension
    sample = _matrix([r["vec"] for r in rows], d) if rows else np.zeros((1, d), np.float32)
    cells = Cells(sample, k, c)
    held, asked = np.zeros(cells.n), np.zeros(cells.n)
    for at in range(0, len(sample), 8192):
        near, searched = cells.nearest(sample[at:at + 8192])
        held += np.bincount(near[:, 0], minlength=cells.n)
        asked += np.bincount(near[searched], minlength=cells.n)
    scale = max(n, 1) / len(sample)
    parts = np.maximum(1, np.ceil(scale * held / (2 * c.shard))).astype(int)
    blocks = np.maximum(1, np.ceil(scale * asked / c.queries)).astype(int)
    first = np.concatenate([[0], np.cumsum(parts * blocks)])
    sent = spark.sparkContext.broadcast((cells, parts, blocks, first))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members go to their part of the nearest cell, in all its blocks; queries to one block of all parts of near cells."""
        cells, parts, blocks, first = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            near, searched = cells.nearest(_matrix(b.column("vec").to_pylist(), d))
            h = (b.column("cls").to_numpy().astype(np.uint64) * shingles.PRIME) >> np.uint64(33)
            row, probe = np.nonzero(searched)
            cell = near[row, probe]
            # Every (part, block) of each near cell; of these only the ones that a member or query belongs to are sent.
            n_each = parts[cell] * blocks[cell]
            inner = np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            row, probe, cell = (np.repeat(v, n_each) for v in (row, probe, cell))
            member = (probe == 0) & (inner // blocks[cell] == (h[row] % parts[cell].astype(np.uint64)).astype(int))
            query = inner % blocks[cell] == (h[row] // np.uint64(64) % blocks[cell].astype(np.uint64)).astype(int)
            keep = np.flatnonzero(member | query)
            moved = b.take(pa.array(row[keep]))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array((first[cell] + inner)[keep].astype(np.int32)), "role": pa.array((member + 2 * query)[keep].astype(np.int32)),
                "cls": moved.column("cls"), "ids": moved.column("ids"), "vec": moved.column("vec"),
            })

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        cls, role, x = t["cls"].to_numpy(), t["role"].to_numpy(), _matrix(t["vec"].to_pylist(), d)
        ids = t["ids"].combine_chunks()
        names, (begins, ends) = np.array(ids.values.to_pylist(), object), (ids.offsets.to_numpy()[:-1], ids.offsets.to_numpy()[1:])
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable") if len(names) else np.empty(0, int)
        members = np.flatnonzero(role & 1)
        a, b = [np.flatnonzero(role == 3)], [np.flatnonzero(role == 3)]  # a class's own ids are candidates too
        if len(members):
            index = HNSW(x[members], c.graph)
            own = np.full(len(x), -1)
            own[members] = np.arange(len(members))
            for queries, inside in ((a[0], True), (np.flatnonzero(role == 2), False)):
                if len(queries):
                    found, _ = index.search(x[queries], min(c.k + 3, len(members) + 1), own[queries][:, None] if inside else None)
                    q, j = np.nonzero(found >= 0)
                    a.append(queries[q][queries[q] != members[found[q, j]]])
                    b.append(members[found[q, j]][queries[q] != members[found[q, j]]])
        a, b = np.concatenate(a), np.concatenate(b)
        exact = np.ones(len(a))
        z = x.astype(np.float64)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        for at in range(0, len(a), 65_536):
            i, j = a[at:at + 65_536], b[at:at + 65_536]
            exact[at:at + 65_536] = np.where(i == j, 1.0, np.einsum("ij,ij->i", z[i], z[j]))
        size = (ends - begins)[b]
        name = np.repeat(begins[b], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, exact = np.repeat(a, size), np.repeat(exact, size)
        order = np.lexsort((rank[name], -exact, a))
        a, exact, name = a[order], exact[order], name[order]
        who, begin = np.unique(a, return_index=True)
        keep = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) <= c.k
        a, exact, name = a[keep], exact[keep], name[keep]
        begin = np.searchsorted(a, np.append(who, len(x)))
        near = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays([pa.array(-exact), pa.array(names[name].tolist(), pa.string())], ["s", "id"]))
        return pa.table({"cls": pa.array(cls[who]), "near": near})

    routed = classes.select("cls", "ids", "vec").mapInArrow(route, "shard int, role int, cls long, ids array<string>, vec binary")
    # A range of shards per task, about one: hashing few shards to tasks would pile several on one.
    routed = routed.repartitionByRange(max(runtime.slots(spark), int(first[-1])), "shard")
    found = routed.groupBy("shard").applyInArrow(search, "cls long, near array<struct<s:double,id:string>>")
    return found.groupBy("cls").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, c.k + 1).alias("near"))


def neighbours(vectors: DataFrame, c: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """vectors(id STRING, embedding ARRAY<FLOAT>) -> (id, other_id, similarity): up to k others of every usable id."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    ids = runtime.cut(unit_rows(vectors, c.dimension, False).groupBy("id").agg(F.max("cls").alias("cls")))
    # Of a class of copies only the smallest k + 1 ids can be anyone's neighbours.
    low = ids.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= c.k + 1)
    low = low.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vec = unit_rows(vectors, c.dimension, True).groupBy("cls").agg(F.first("vec").alias("vec"))
    classes = runtime.cut(low.join(vec, "cls"))
    near = class_neighbours(classes, c)
    return (
        ids.join(near, "cls")
        .select("id", F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, c.k)).alias("x"))
        .select("id", F.col("x.id").alias("other_id"), (-F.col("x.s")).alias("similarity"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors_of(runtime.read(spark, sf_dir, "chunks"), runtime.read(spark, sf_dir, "reference_embeddings"))
    found = neighbours(v)
    return found.select(F.least("id", "other_id").alias("vec_id_a"), F.greatest("id", "other_id").alias("vec_id_b")).distinct()


def recall(vectors: DataFrame, c: NeighbourConfig = NeighbourConfig(), every: int = 100) -> DataFrame:
    """(n_queries, recall): neighbours() of the ids whose hash is divisible by `every`, against all vectors one by one.

    The stated queries, all of them, are sent to the vectors in blocks; each task keeps its best per query, which are merged.
    """
    found = runtime.cut(neighbours(vectors, c).where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
    rows = runtime.cut(unit_rows(vectors, c.dimension, True).groupBy("id").agg(F.max(F.struct("cls", "vec")).alias("s")).select("id", "s.vec"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec").to_pylist(), c.dimension).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "vec": pa.array(list(x), pa.list_(pa.float64()))})

    good = rows.mapInArrow(numbers, "id string, vec array<double>")
    asked = good.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    truth = knn.knn_matrix(good, asked, c.k + 1, c.dimension).where("query_id <> id")
    best = Window.partitionBy("query_id").orderBy("rank")
    truth = truth.withColumn("r", F.row_number().over(best)).where(F.col("r") <= c.k).select("query_id", "id")
    per = metrics.index_recall(truth, found.select(F.col("id").alias("query_id"), F.col("other_id").alias("id")))
    return per.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(vectors_of(runtime.read(spark, sf_dir, "chunks"), runtime.read(spark, sf_dir, "reference_embeddings")))
