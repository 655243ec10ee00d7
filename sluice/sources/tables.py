"""The star-schema and text tables as bases of the language."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.catalog import Bounded, Catalog
from sluice.sources.schema import Base, Schema

#: Events from this second on are raw metric values; earlier ones are hourly averages.
ROLLUP_BEFORE = 1_705_363_200


def epoch(c: str):
    """Seconds since 1970 of a timestamp without a zone, read as UTC whatever the session's zone is."""
    return F.expr(f"unix_seconds(from_utc_timestamp(cast({c} as timestamp), current_timezone()))")


def between(df: DataFrame, c: str, earliest: int, latest: int) -> DataFrame:
    """df with c, a timestamp without a zone, within whole seconds (0 for no bound).

    The bounds are literals of the column's own type, so they reach Parquet.
    """
    known = [(">=", earliest)] * (earliest > 0) + [("<", latest + 1)] * (latest > 0)
    for op, seconds in known:
        if seconds < 253_402_300_800:  # the year 10000
            df = df.where(F.expr(f"`{c}` {op} timestamp_ntz '{datetime(1970, 1, 1) + timedelta(seconds=seconds)}'"))
    return df


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """Lazy tables over folder/<name>.parquet."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")

    def events(earliest: int = 0, latest: int = 0) -> DataFrame:
        return between(read("events"), "ts", earliest, latest).withColumn("ts", epoch("ts")).withColumn("env_id", F.when(F.col("event_id") % 2 == 0, "prod").otherwise("dev"))

    def named(earliest: int, latest: int) -> DataFrame:
        return events(earliest, latest).select("ts", F.col("user_id").cast("string").alias("host"), F.col("event_type").alias("name"), F.col("props").alias("labels"), "value", "user_id")

    def metric(earliest: int, latest: int) -> DataFrame:
        return named(max(earliest, ROLLUP_BEFORE), latest)

    def rollup(earliest: int, latest: int) -> DataFrame:
        hour = F.expr("ts div 3600 * 3600").alias("ts")  # an hour that begins in time is whole
        until = min(latest + 3599, ROLLUP_BEFORE - 1) if latest > 0 else ROLLUP_BEFORE - 1
        return named(earliest, until).groupBy(hour, "host", "name", "labels", "user_id").agg(F.avg("value").alias("avg"))

    def lookups() -> DataFrame:
        def rows(name: str, key: str) -> DataFrame:
            df = read(name)
            return df.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("val"))

        return rows("nation", "n_nationkey").unionByName(rows("region", "r_regionkey"))

    timed = {"orders": "o_orderdate", "lineitem": "l_shipdate"}
    plain = ("documents", "pages", "conversations", "orders", "lineitem", "customer", "part", "supplier", "nation", "region", "labels")
    tables = {n: (lambda n=n: read(n)) for n in plain if n not in timed}
    tables |= {n: Bounded(lambda a, b, n=n, c=c: between(read(n), c, a, b).withColumn("ts", epoch(c))) for n, c in timed.items()}
    return Catalog(tables | {"events": Bounded(events), "metric": Bounded(metric), "metric_rollup": Bounded(rollup), "lookup_kv": lookups})


def schema() -> Schema:
    """`search` is events; other tables are bases of their own."""
    base = lambda keyword, table, columns, freetext=None: Base(keyword, table, tuple(columns.split()), (), None, freetext)
    return Schema(
        Base("search", "events", ("event_id", "ts", "user_id", "event_type", "value", "props"), ("env_id",), "props", "event_type", True),
        (
            base("docs", "documents", "doc_id text lang source n_chars", "text"),
            base("pages", "pages", "page_id url html", "html"),
            base("conv", "conversations", "conv_id turn role text", "text"),
            base("orders", "orders", "ts o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority"),
            base("lineitem", "lineitem", "ts l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"),
            base("customer", "customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
            base("part", "part", "p_partkey p_name p_brand p_type p_size p_retailprice"),
            base("supplier", "supplier", "s_suppkey s_name s_nationkey s_acctbal"),
            base("nation", "nation", "n_nationkey n_name n_regionkey"),
            base("region", "region", "r_regionkey r_name"),
            base("labels", "labels", "doc_id quality toxic"),
        ),
        metric=True,
    )
