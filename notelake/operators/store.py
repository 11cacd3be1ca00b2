"""The note store as transforms: create, update, delete with its chunks, and chunking what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import ChunkConfig, chunk


def latest_notes(notes: DataFrame) -> DataFrame:
    """One row per note: the state saved last; nulls first, then the cleared flag."""
    cols = [c for c in notes.columns if c != "note_id"]
    state = F.struct("updated_at", (~F.coalesce("needs_reindexing", F.lit(False))).alias("clean"), *[c for c in cols if c not in ("updated_at",)])
    return notes.where("note_id is not null").groupBy("note_id").agg(F.max(state).alias("s")).select("note_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def create(notes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """new(note_id, title, content): added, flagged for chunking."""
    return notes.unionByName(new.select("note_id", "title", "content", now.alias("created_at"), now.alias("updated_at"), F.lit(True).alias("needs_reindexing")))


def update(notes: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(note_id, new_title, new_content), one row per note. The flag is set only where the content differs; updated_at always moves."""
    j = notes.join(changes.withColumn("_hit", F.lit(True)), "note_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    differs = hit & ~F.col("content").eqNullSafe(F.col("new_content"))
    return j.select(
        "note_id",
        F.when(hit, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.col("new_content")).otherwise(F.col("content")).alias("content"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        (F.coalesce("needs_reindexing", F.lit(False)) | differs).alias("needs_reindexing"),
    )


def delete(notes: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and chunks without the notes of ids(note_id)."""
    gone = ids.select("note_id").distinct()
    return notes.join(gone, "note_id", "left_anti"), chunks.join(gone, "note_id", "left_anti")


def chunk_notes(notes: DataFrame, c: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(chunk_id, note_id, chunk_index, content, embedding null) of the notes' contents; blank notes have none."""
    parts = notes.select("note_id", F.posexplode(chunk(F.col("content"), c)).alias("chunk_index", "content"))
    key = F.sha2(F.concat_ws(":", F.col("note_id").cast("string"), F.col("chunk_index").cast("string"), F.col("content")), 256)
    return parts.select(key.alias("chunk_id"), "note_id", "chunk_index", "content", F.lit(None).cast("array<float>").alias("embedding"))


def reindex(notes: DataFrame, chunks: DataFrame, c: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """Flagged notes get new chunks in place of all old ones; flags are cleared."""
    dirty = notes.where("needs_reindexing")
    kept = chunks.join(dirty.select("note_id").distinct(), "note_id", "left_anti")
    return notes.withColumn("needs_reindexing", F.lit(False)), kept.unionByName(chunk_notes(dirty, c).select(chunks.columns))
