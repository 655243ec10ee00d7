"""Shared storage for results that are read more than once."""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in a local session, where driver and executors are one process, is a
    temporary folder made and set if that setting is missing; on a cluster its lack
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def read_bytes(df: DataFrame) -> int:
    """The stored bytes of the tables that df reads, as the optimiser knows them; very many where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _write(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back.

    Its files are as many as the bytes of the tables that it reads ask for
    (spark.sql.files.maxPartitionBytes each), and three for each core at least:
    small files cost the file system some calls each.
    """
    spark, schema, read = df.sparkSession, df.schema, read_bytes(df)
    each = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    files = max(3 * spark.sparkContext.defaultParallelism, math.ceil(read / each))
    df.coalesce(min(files, (1 << 31) - 1)).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under folder() and return it read back.

    This cuts the lineage with files that survive the loss of executors. The
    files go when the driver's Python exits.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    release(spark)
    found = _write(df, path)
    atexit.register(_remove, spark, path)
    return found


class Scratch:
    """Tables that a chain of steps writes; leaving the context deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{folder(spark)}/sluice-scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        atexit.register(_remove, self.spark, self.path)
        return self

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and read back."""
        self.count += 1
        return _write(df, f"{self.path}/{self.count}-{name}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark finds them when the driver's heap is collected, which a driver with
    little to do may not come to for a long time; without this a chain of steps
    keeps the files of all of them. It has to come after the plans are let go:
    what is still held then is kept all the longer.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
