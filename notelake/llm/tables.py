"""Views of the driver tables that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_notes(notes: DataFrame) -> DataFrame:
    """One row (note_id, title, content) per note.

    The states of a note agree in title and content; where they don't, the state saved last is
    taken (null updated_at first, then the larger text). Rows without a note_id are left out.
    """
    seen = F.coalesce(F.col("updated_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    return (
        notes.where("note_id is not null")
        .select("note_id", F.struct(seen.alias("at"), "content", "title").alias("s"))
        .groupBy("note_id").agg(F.max("s").alias("s"))
        .select("note_id", F.col("s.title").alias("title"), F.col("s.content").alias("content"))
    )


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row (chunk_id, content) per chunk; the larger content where copies differ."""
    return (
        chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("content").alias("content"))
    )


def items_of(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id STRING, content) of every distinct note and chunk."""
    a = distinct_notes(notes).select(F.lit("note").alias("item_kind"), F.col("note_id").cast("string").alias("item_id"), "content")
    b = distinct_chunks(chunks).select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "content")
    return a.unionByName(b)
