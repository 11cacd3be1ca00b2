"""Embedding: a pluggable interface, a deterministic stand-in, fixed vectors, pooling, and filling what is pending."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from notelake.functions.text import with_prefix
from notelake.functions.vector import dot, is_valid, norm

Embedder = Callable[[Column], Column]

# FNV-1a of 64 bits, and the linear congruential step.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def mock_vectors(texts: list[str], dimension: int) -> np.ndarray:
    """Unit vectors that depend on the texts' bytes only, one byte of all texts at a time; all components are non-negative."""
    raw = [t.encode("utf-8") for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    seed = np.full(len(raw), FNV_BASIS, np.uint64)
    lengths = np.array([len(raw[i]) for i in order], np.int64)
    joined, starts = np.frombuffer(b"".join(raw[i] for i in order), np.uint8), np.cumsum(lengths) - lengths
    active = len(raw)
    for j in range(int(lengths.max(initial=0))):
        while active and lengths[active - 1] <= j:
            active -= 1
        seed[:active] = (seed[:active] ^ joined[starts[:active] + j]) * np.uint64(FNV_PRIME)
    out, state = np.empty((len(raw), dimension), np.float32), seed
    for i in range(dimension):
        state = state * np.uint64(LCG_A) + np.uint64(LCG_C)
        out[:, i] = (state >> np.uint64(33)).astype(np.float32) / np.float32(2 ** 31 - 1)
    n = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)[:, None]
    back = np.empty_like(out)
    back[order] = np.divide(out, n, out=out.copy(), where=n > 0)
    return back


def mock_vector(text: str, dimension: int) -> np.ndarray:
    return mock_vectors([text], dimension)[0]


def mock_embedder(dimension: int = 64) -> Embedder:
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        known = texts.dropna().unique().tolist()
        done = dict(zip(known, mock_vectors(known, dimension), strict=True))
        return texts.map(lambda t: None if t is None else done[t])

    return embed


def embed_texts(rows: DataFrame, text: str, kind: str, embedder: Embedder, fixed: DataFrame | None = None, out: str = "vec") -> DataFrame:
    """Adds a vector of the prefixed text; fixed(text, vec), by prefixed text, goes before the embedder."""
    rows = rows.withColumn("_p", with_prefix(kind, F.col(text)))
    if fixed is None:
        return rows.withColumn(out, embedder(F.col("_p"))).drop("_p")
    rows = rows.join(fixed.select(F.col("text").alias("_p"), F.col("vec").alias("_f")), "_p", "left")
    return rows.withColumn(out, F.coalesce("_f", embedder(F.col("_p")))).drop("_p", "_f")


def embed_pending(chunks: DataFrame, embedder: Embedder, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all chunks with vectors, the newly embedded ones); a second run finds none pending."""
    pending = chunks.where("embedding is null")
    done = embed_texts(pending.drop("embedding"), "content", "passage", embedder, fixed, "embedding").select(chunks.columns)
    return chunks.where("embedding is not null").unionByName(done), done


def truncate_tokens(ids: Column, most: int = 512) -> Column:
    """The first most - 1 tokens and the last one, of longer lists."""
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, most - 1), F.array(F.element_at(ids, -1)))).otherwise(ids)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors by mask (at least 1e-9 in total), to unit length."""
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(F.slice(weighted, 2, F.greatest(F.size(weighted) - 1, F.lit(0))), F.element_at(weighted, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    mean = F.transform(total, lambda x: x / weight)
    n = norm(mean)
    return F.when(n > 0, F.transform(mean, lambda x: x / n)).otherwise(mean)


def compare_embedders(pairs: DataFrame, a: str, b: str, least: float = 0.999) -> DataFrame:
    """(n, min_cosine, passed) of two vector columns."""
    n = norm(F.col(a)) * norm(F.col(b))
    c = F.when(n > 0, dot(F.col(a), F.col(b)) / n)
    return pairs.agg(F.count(c).alias("n"), F.min(c).alias("min_cosine")).withColumn("passed", F.col("min_cosine") > least)


def valid_vectors(chunks: DataFrame, dimension: int) -> DataFrame:
    """(id, note_id, content, vec) of chunks with a usable vector, one row per chunk."""
    return (
        chunks.where(F.col("chunk_id").isNotNull() & is_valid(F.col("embedding"), dimension)).groupBy("chunk_id")
        .agg(F.min("note_id").alias("note_id"), F.max("content").alias("content"), F.max("embedding").alias("vec"))
        .withColumnRenamed("chunk_id", "id")
    )
