"""Writing events, metrics and snapshots; every sink appends.

Events and metrics are partitioned by day and by the batch that wrote them. A batch
of a stream replaces itself when it is written again, so that a replay adds nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.catalog import Bounded, Catalog

EVENT = "ts bigint, host string, source string, category string, severity bigint, src_ip string, dst_ip string, url string, xff string, message string, fields string, dedup string, id bigint, env_id string"
METRIC = "ts bigint, host string, name string, labels string, value double"
SNAPSHOT = "ts bigint, kind string, hash string, data string, host string"
DEFAULT_ENV = "prod"
DAY = 86400
LOOKUP = "name string, key string, val string"
ROLLUP = "ts bigint, host string, name string, labels string, avg double"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns in order; missing ones are null, env_id is 'prod' then."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        have = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(have, F.lit(DEFAULT_ENV)) if name == "env_id" else have).alias(name))
    return df.select(*out)


class Store:
    """Parquet tables under one folder."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _append(self, df: DataFrame, table: str, batch: str | None) -> None:
        path = f"{self.folder}/{table}"
        timed = df.withColumn("day", F.expr(f"ts div {DAY}")).withColumn("batch", F.lit(batch or "direct"))
        if batch is None:
            timed.write.mode("append").partitionBy("day", "batch").parquet(path)
        else:
            timed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    def insert_events(self, df: DataFrame, batch: str | None = None) -> None:
        self._append(conform(df, EVENT), "event", batch)

    def insert_metrics(self, df: DataFrame, batch: str | None = None) -> None:
        self._append(conform(df, METRIC), "metric", batch)

    def insert_snapshots(self, df: DataFrame) -> None:
        conform(df, SNAPSHOT).write.mode("append").parquet(f"{self.folder}/snapshot")

    def read(self, spark, table: str, earliest: int = 0, latest: int = 0) -> DataFrame:
        """A table, empty before anything was written; bounds in seconds keep the days that they touch."""
        try:
            df = spark.read.parquet(f"{self.folder}/{table}")
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], {"event": EVENT, "metric": METRIC, "snapshot": SNAPSHOT}[table])
        if "day" in df.columns:
            if earliest > 0:
                df = df.where(F.col("day") >= earliest // DAY)
            if latest > 0:
                df = df.where(F.col("day") <= latest // DAY)
            df = df.drop("day", "batch")
        return df

    def catalog(self, spark, lookups: DataFrame | None = None, rollup: DataFrame | None = None) -> Catalog:
        """The store's tables for queries, with lookup and rolled-up metric tables of the caller's."""
        timed = {n: Bounded(lambda a, b, n=n: self.read(spark, n, a, b)) for n in ("event", "metric")}
        none = lambda schema: lambda: spark.createDataFrame([], schema)
        return Catalog(timed | {"snapshot": lambda: self.read(spark, "snapshot"), "lookup_kv": none(LOOKUP) if lookups is None else lookups, "metric_rollup": none(ROLLUP) if rollup is None else rollup})
