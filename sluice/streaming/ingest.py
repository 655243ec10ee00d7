"""The batch pieces of the language on streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.errors import QueryError
from sluice.functions.values import Value, aggregate
from sluice.plans.nodes import Aggregate
from sluice.sources.sinks import Store

#: Aggregates whose state does not grow with a bucket's rows.
AGGREGATES = ("count", "sum", "avg", "min", "max")


def ingest_events(stream: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of events to the store, batch by batch.

    A batch is named after the checkpoint and its number, so that one that is
    replayed after a failure replaces what it wrote before.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = stream.writeStream.foreachBatch(lambda df, n: store.insert_events(df, f"{name}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def timechart(stream: DataFrame, span: int, by: tuple[str, ...] = (), late: str = "10 minutes", measure: Aggregate = Aggregate()) -> DataFrame:  # noqa: B008  frozen
    """bucket, by..., the aggregate over a stream with ts in seconds; buckets close `late` after their end."""
    if measure.function not in AGGREGATES:
        raise QueryError(f"aggregate not supported on a stream: {measure.function}")
    field = Value(F.col(f"`{measure.field}`"), stream.schema[measure.field].dataType) if measure.field else None
    timed = stream.withColumn("#at", F.timestamp_seconds("ts")).withWatermark("`#at`", late)
    made = timed.groupBy(F.window("`#at`", f"{int(span)} seconds").alias("#w"), *by).agg(aggregate(measure, field).alias(measure.function))
    return made.select(F.unix_seconds(F.col("`#w`.start")).alias("bucket"), *by, measure.function)


def dedup(stream: DataFrame, names: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withColumn("#at", F.timestamp_seconds("ts")).withWatermark("`#at`", late).dropDuplicatesWithinWatermark([*names]).drop("#at")
