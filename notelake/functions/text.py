"""Text expressions: trimming, prefixes, titles, paragraphs, sentences; hard splits and packing in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from notelake import runtime
from notelake.functions import packing
from notelake.functions.text_size import NEWLINE_CLASS

UNTITLED = "無題"
#: The engine's own sentence rule for packing: up to terminators and the blanks after them.
SENTENCE = r"[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$"


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 300
    most: int = 400
    overlap: int = 50


def trim_blanks(t: Column) -> Column:
    """Without white space around, line ends kept."""
    return F.regexp_replace(t, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")


def trim_all(t: Column) -> Column:
    """Without white space and line ends around."""
    return F.regexp_replace(t, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def with_prefix(kind: str, t: Column) -> Column:
    return F.concat(F.lit(f"{kind}: "), t)


def title_or_default(t: Column) -> Column:
    return F.when(t.isNull() | (t == ""), F.lit(UNTITLED)).otherwise(t)


def score_text(s: Column) -> Column:
    return F.format_string("%.2f", s)


def paragraphs(t: Column) -> Column:
    """Lines without white space around, empty ones left out."""
    return F.filter(F.transform(F.split(t, f"[{NEWLINE_CLASS}]"), trim_blanks), lambda x: x != "")


def sentences(p: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), trim_blanks), lambda x: x != "")


def hard_split(t: Column, most: int) -> Column:
    """Pieces of graphemes, cut before one that would exceed the size; joined they are the text. Null for null."""
    runtime.ship(SparkSession.active())

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else packing.hard_split(x, most))

    return split(t)


def chunk(t: Column, c: ChunkConfig = ChunkConfig()) -> Column:
    """Chunks of a text; empty for a blank one, null for null."""
    runtime.ship(SparkSession.active())

    @F.pandas_udf(ArrayType(StringType()))
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else packing.chunks(x, c.target, c.most, c.overlap))

    return pack(t)
