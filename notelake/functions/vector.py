"""Vector expressions in double precision, inside codegen."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a vector or a number is null or lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """Divided by the norm if that is above zero, else as it is; doubles."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_valid(a: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite numbers."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimension) & finite, F.lit(False))


def checked(a: Column, dimension: int) -> Column:
    """The vector; a wrong dimension is an error, as the index's contract demands."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit("vector of dimension "), F.size(a).cast("string"))))


@F.pandas_udf(BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes of a vector; null for null."""
    return v.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
