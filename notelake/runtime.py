"""Session helpers: shipping the package to executors, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="notelake_")) / "notelake_pkg.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def send_file(spark: SparkSession, path: str) -> str:
    """Ship a file of the driver to all nodes; the name by which tasks find it (see sent_file)."""
    sc = spark.sparkContext
    name = os.path.basename(path)
    if (sc.applicationId, path) not in _SHIPPED:
        sc.addFile(path)
        _SHIPPED.add((sc.applicationId, path))
    return name


def sent_file(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a folder of this machine only where master and tasks are one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="notelake_ckpt_")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and return it without its lineage.

    Parquet with zstd takes a fraction of what checkpoint() writes; the files outlive lost executors alike. They are
    read until the caller's result is computed, so they stay until the application ends: then they are removed, where
    the session's spark.cleaner.referenceTracking.cleanCheckpoints doesn't forbid it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if spark.conf.get("spark.cleaner.referenceTracking.cleanCheckpoints", "true") != "false":
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the least width of Python-heavy stages."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of_plan(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df; for scans the size of the files and columns read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def width_for(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions for a shuffle of df: by its size, and no fewer than the session's."""
    return max(slots(df.sparkSession), -(-min(size_of_plan(df), 1 << 50) // each))


def spread(scan: DataFrame) -> DataFrame:
    """scan, with enough partitions for work in Python.

    A scan with enough splits is left as it is, so large inputs aren't moved; only one too small to occupy the session's
    width is dealt out.
    """
    spark = scan.sparkSession
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return scan if size_of_plan(scan) >= 2 * slots(spark) * split else scan.repartition(slots(spark))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
