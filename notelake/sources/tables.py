"""Sources and sinks: Parquet tables, the JSON fixtures, and in-memory stores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.sources import schemas


def notes_recent_first(notes: DataFrame) -> DataFrame:
    """Notes by updated_at, latest first; nulls last, ties by note_id."""
    return notes.orderBy(F.desc_nulls_last("updated_at"), "note_id")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_SET).option("mode", "FAILFAST").json(path, multiLine=True)


def read_reference(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A document per file, or with lines one per line, as write_reference() leaves them."""
    return spark.read.schema(schemas.REFERENCE).option("mode", "FAILFAST").json(path, multiLine=not lines)


def write_reference(reference: DataFrame, path: str) -> None:
    """Reference vectors as JSON, rounded to six places."""
    rounded = F.transform("cases", lambda c: F.struct(
        c["id"].alias("id"), c["text"].alias("text"), c["token_ids"].alias("token_ids"),
        F.transform(c["embedding"], lambda x: F.round(x, 6)).alias("embedding"),
    ))
    reference.withColumn("cases", rounded).write.mode("overwrite").json(path)


def qrels(eval_set: DataFrame) -> DataFrame:
    """(query_id, note_id, grade), one row per label."""
    return eval_set.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), F.explode("q.relevant").alias("note_id", "grade"))


def eval_queries(eval_set: DataFrame) -> DataFrame:
    return eval_set.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.text").alias("text"))


def eval_notes(eval_set: DataFrame) -> DataFrame:
    return eval_set.select(F.explode("notes").alias("n")).select(F.col("n.id").alias("note_id"), F.col("n.title").alias("title"), F.col("n.content").alias("content"))


def reference_cases(reference: DataFrame) -> DataFrame:
    """(model_id, id, text, token_ids, embedding) of every case."""
    return reference.select("model_id", F.explode("cases").alias("c")).select("model_id", "c.*")


def memory_notes(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.NOTES)


def memory_chunks(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.CHUNKS)
