"""Seeded synthetic vectors: each row depends on the seed and its id only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from notelake import runtime

SCHEMA = "id long, vec array<float>"


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def uniform_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 1) -> DataFrame:
    """Components uniform in -1..1, to unit length."""
    runtime.ship(spark)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array([np.random.default_rng((seed, i)).uniform(-1, 1, dimension) for i in f["id"].tolist()]).reshape(len(f), dimension)
            yield pd.DataFrame({"id": f["id"], "vec": list(_unit(x))})

    return spark.range(n).mapInPandas(rows, SCHEMA)


def gaussian(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Standard normal numbers of two uniform ones (Box and Muller)."""
    return np.sqrt(-2 * np.log(np.maximum(u, 1e-12))) * np.cos(2 * np.pi * v)


def clustered_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 1, spread: float = 0.05) -> DataFrame:
    """Unit centres, max(20, n / 100) of them, with normal noise, to unit length."""
    runtime.ship(spark)
    clusters = max(20, n // 100)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i in f["id"].tolist():
                rng = np.random.default_rng((seed, 1, i))
                c = np.random.default_rng((seed, 2, int(rng.integers(clusters)))).uniform(-1, 1, dimension)
                c = c / np.linalg.norm(c)
                out.append(c + spread * gaussian(rng.random(dimension), rng.random(dimension)))
            yield pd.DataFrame({"id": f["id"], "vec": list(_unit(np.array(out).reshape(len(f), dimension)))})

    return spark.range(n).mapInPandas(rows, SCHEMA)
