"""Line deduplication, native.

Hashes of line keys are range-partitioned with document and position as the
secondary sort, so that one very frequent line is spread over many partitions.
Streaming over the sorted runs gives the number of documents and the first
(largest) document of each key; what comes back is a run-length keep bitmap for
each document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.native import BLANKS, ascii_lower

MIN_CHARS, MIN_DOCS = 40, 5


def split_lines(text: Column) -> Column:
    """The lines of a text; one empty line for null or empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns #n and #dropped of its rows in keep_bitmaps(), null for those without."""
    found = bitmaps.select(F.col(key).alias("#id"), F.col("h").alias("#h"), F.col("n_dropped").alias("#n"), F.col("dropped").alias("#dropped"))
    return docs.join(found, F.col(key).eqNullSafe(F.col("`#id`")) & (_hash(F.col(text)) == F.col("`#h`")), "left").drop("#id", "#h")


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, h, n_dropped and dropped for each document that loses lines; h is xxhash64 of its text.

    dropped is the keep bitmap as runs: array<struct<start, length>> of line
    positions (from 0) that go, ascending and disjoint; all others stay.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys
    of at least min_chars code points found in at least min_docs documents lose
    all lines but those in the largest key column value. A document is a key and a
    text: repeated rows count as one, different texts of one key as several. A null id
    sorts below all others. Keys are compared by two independent 64-bit hashes.
    """
    spark = docs.sparkSession
    stripped = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = (
        docs.select(F.col(key).alias("id"), _hash(F.col(text)).alias("h"), F.posexplode(split_lines(F.col(text).cast("string"))).alias("pos", "line"))
        .where(F.char_length(stripped) >= min_chars)
        .select("id", "h", "pos", ascii_lower(stripped).alias("k"))
        .select("id", "h", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h1", "h2", F.col("id").desc_nulls_last(), "h").sortWithinPartitions("h1", "h2", F.col("id").desc_nulls_last(), "h", "pos")
    held = ranged.groupBy("h1", "h2", "id", "h").agg(F.collect_list("pos").alias("at"))
    # Counting the lines too keeps both uses of held alike, so that its exchange is made once.
    runs = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("first"), F.sum(F.size("at")).alias("lines"))
    runs = runs.where((F.col("n") >= min_docs) & (F.col("lines") >= min_docs))
    # A key of its own for the join lets adaptive execution split a frequent line's
    # partition, which it doesn't where an aggregate's partitioning is reused.
    runs = runs.select(F.col("h1").bitwiseXOR(F.col("h2")).alias("r"), F.col("h1").alias("r1"), "first")
    lost = held.join(runs, (F.col("h1").bitwiseXOR(F.col("h2")) == F.col("r")) & (F.col("h1") == F.col("r1"))).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = lost.groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    return gone.select(
        F.col("id").alias(key),
        "h",
        F.size("p").cast("long").alias("n_dropped"),
        F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("dropped"),
    )


def kept_text(text: Column, dropped: Column) -> Column:
    """text without the lines in dropped (as keep_bitmaps gives them; null: none)."""
    lines = split_lines(text)
    before = F.transform(dropped, lambda r, i: F.struct(F.coalesce(F.get(dropped, i - 1)["start"] + F.get(dropped, i - 1)["length"], F.lit(0)).alias("from"), r["start"].alias("start"), r["length"].alias("length")))
    mask = F.flatten(F.transform(before, lambda r: F.concat(F.array_repeat(F.lit(True), r["start"] - r["from"]), F.array_repeat(F.lit(False), r["length"]))))
    rest = F.zip_with(lines, mask, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(rest, "\n"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the remaining text) for each row.

    Every row of docs comes back once, with its own columns replaced by key,
    text, n_lines, n_dropped and kept, whatever other columns it has.
    """
    joined = with_bitmaps(docs.select(key, F.col(text).cast("string").alias(text)), keep_bitmaps(docs, key, text, **limits), key, text)
    return joined.select(
        key,
        text,
        F.size(split_lines(F.col(text))).cast("long").alias("n_lines"),
        F.coalesce("`#n`", F.lit(0).cast("long")).alias("n_dropped"),
        kept_text(F.col(text), F.col("`#dropped`")).alias("kept"),
    )
