"""Extension: a stream of note changes kept in a versioned table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.store import latest_notes
from notelake.sources.schemas import NOTES


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of note states as they arrive."""
    return spark.readStream.schema(NOTES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_batch(target: str):
    """A foreachBatch sink: version N + 1 is version N with the batch's newer states. A batch that is run again is harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = batch
        if batch_id > 0:
            states = spark.read.schema(NOTES).parquet(f"{target}/v={batch_id - 1}").unionByName(batch)
        latest_notes(states).select([f.name for f in NOTES.fields]).write.mode("overwrite").parquet(f"{target}/v={batch_id}")

    return write


def run_available(changes: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there, then stop."""
    changes.writeStream.foreachBatch(upsert_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def edits_per_hour(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of saved states per hour, with a watermark for late ones."""
    return changes.withWatermark("updated_at", late).groupBy(F.window("updated_at", "1 hour")).count()
