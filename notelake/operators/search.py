"""Semantic search: chunk hits, their notes, and the best chunk per note."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import trim_all
from notelake.operators.knn import knn


def asked(questions: DataFrame) -> DataFrame:
    """questions(query_id, text, ...) with trimmed texts; blank ones are left out."""
    return questions.withColumn("text", trim_all(F.col("text"))).where(F.coalesce(F.col("text"), F.lit("")) != "")


def top_chunks(vectors: DataFrame, notes: DataFrame, queries: DataFrame, limit: int, dimension: int, strategy: str = "exact") -> DataFrame:
    """(query_id, rank, chunk_id, note_id, title, content, score) by score.

    vectors(id, note_id, content, vec). Hits whose note is gone are dropped after the cut, so fewer may remain.
    """
    hits = knn(vectors.select("id", "vec"), queries, limit, dimension, strategy)
    return (
        hits.join(vectors.select("id", "note_id", "content"), "id").join(notes.select("note_id", "title"), "note_id")
        .select("query_id", "rank", F.col("id").alias("chunk_id"), "note_id", "title", "content", "score")
    )


def candidates_for(limit: int) -> int:
    """Chunks fetched for so many notes: a rule of the search's semantics, not a tuning."""
    return max(5 * limit, 30)


def best_per_note(hits: DataFrame) -> DataFrame:
    """The first of a note's best-scored chunks."""
    first = Window.partitionBy("query_id", "note_id").orderBy("rank")
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def search_notes(vectors: DataFrame, notes: DataFrame, queries: DataFrame, limit: int, dimension: int, strategy: str = "exact") -> DataFrame:
    """(query_id, place, note_id, chunk_id, title, excerpt, score): the best notes among the fetched chunks."""
    hits = top_chunks(vectors, notes, queries, candidates_for(limit) if limit > 0 else 0, dimension, strategy)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    return (
        best_per_note(hits).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(limit, 0))
        .select("query_id", "place", "note_id", "chunk_id", "title", F.col("content").alias("excerpt"), "score")
    )
