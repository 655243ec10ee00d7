"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003), native.

Of every sliding window of w hashes of k-word grams the smallest is kept as a
fingerprint. Two texts that share a span of k + w - 1 words share the
fingerprint of that span, so with k = 5 and w = 9 no shared window of 13 words
is missed. Matching fingerprints are extended to whole windows by comparing the
words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.native import words

WINDOW, GRAM = 13, 5
#: Up to so many benchmark windows are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 50_000


def _grams(ws: Column, k: int) -> Column:
    """The hash of each run of k words."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item, span, k: every different window of every item.

    A window is `window` words, or a whole item of fewer words. k is the words of
    a gram: `gram`, or the item's number of words where that is less. An item
    without words has no window. item is a string, empty for null, so that an item
    without an id and one whose id is the empty text are one.
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text).cast("string")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    spans = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("span")).distinct()
    return spans.withColumn("k", F.least(F.size("span"), F.lit(gram)))


def keyed(windows: DataFrame, levels: dict[int, int]) -> DataFrame:
    """windows with the hash that marks a text where the window starts.

    It is the smallest hash of k words in the window; where all grams of k words
    are marked (w is 1, for short items), it is the first one's.
    """
    every = F.transform(F.sequence(F.lit(1), F.size("span") - F.col("k") + 1), lambda i: F.xxhash64(F.slice("span", i, F.col("k"))))
    first = [k for k, w in levels.items() if w == 1]
    return windows.withColumn("hash", F.when(F.col("k").isin(*first), F.xxhash64(F.slice("span", F.lit(1), F.col("k")))).otherwise(F.array_min(every)) if first else F.array_min(every))


MARKS = "array<struct<k:int,hash:bigint,from:int,upto:int>>"


def fingerprints(rows: DataFrame, ws: str, levels: dict[int, int]) -> DataFrame:
    """rows with the column marks: array<struct<k, hash, from, upto>>.

    levels gives the window w for each k. hash is the smallest hash of k words in
    every window that starts at one of the places from to upto (from 0); windows
    beside each other with the same smallest hash make one mark.
    """
    kept = list(rows.columns)
    for k, w in levels.items():
        rows = _mark(rows, ws, k, w)
    return rows.select(*kept, F.concat(F.array().cast(MARKS), *(f"_marks{k}" for k in levels)).alias("marks"))


def _mark(rows: DataFrame, ws: str, k: int, w: int) -> DataFrame:
    """rows with the column _marks<k>."""
    rows = rows.withColumn("_least", _grams(F.col(ws), k))
    if w > 1:
        rows = rows.withColumn("_grams", F.col("_least"))
        least = F.transform(F.sequence(F.lit(1), F.size("_grams") - (w - 1)), lambda i: F.array_min(F.slice("_grams", i, w)))
        rows = rows.withColumn("_least", F.when(F.size("_grams") >= w, least).otherwise(F.slice("_grams", 1, 0)))
    rows = rows.withColumn("_starts", F.array_compact(F.transform("_least", lambda x, i: F.when((i == 0) | (F.get("_least", i - 1) != x), i))))

    def mark(i: Column, j: Column) -> Column:
        upto = F.coalesce(F.get("_starts", j + 1), F.size("_least")) - 1
        return F.struct(F.lit(k).alias("k"), F.get("_least", i).alias("hash"), i.alias("from"), upto.alias("upto"))

    return rows.withColumn(f"_marks{k}", F.transform("_starts", mark))


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_rows, n_words, items, spans for each different (key, text) of docs.

    spans holds each different struct<start, length> (words, from 0) at which a
    benchmark window occurs, ascending; items holds the items of those windows
    as ascending strings. n_rows counts the equal rows of docs.

    docs is read once and its texts are never shuffled: the windows, whose count
    is checked, are broadcast to the marks. Beyond BROADCAST_WINDOWS the marks
    are joined by shuffle, each with its text's words.
    """
    windows = benchmark_windows(benchmark, item, item_text, window, gram)
    sizes = windows.groupBy(F.size("span").alias("n"), "k").count().collect()  # as many rows as there are window lengths: `window` at most
    levels: dict[int, int] = {}
    for n, k, _ in sizes:
        levels[k] = min(levels.get(k, window), n - k + 1 if n == window else 1)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body")).select("id", F.xxhash64("body").alias("h"), words(F.col("body")).alias("ws"))
    marked = fingerprints(rows, "ws", levels)
    # The first mark of a row stands for the row itself.
    itself = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("hash"), F.lit(-1).alias("from"), F.lit(-1).alias("upto")))
    points = marked.select("id", "h", "ws", F.explode(F.concat(itself.cast(MARKS), F.col("marks"))).alias("m")).select("id", "h", "ws", "m.*")
    windows = keyed(windows, levels).withColumnsRenamed({"k": "w_k", "hash": "w_hash"})
    if sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    joined = points.join(windows, (F.col("k") == F.col("w_k")) & (F.col("hash") == F.col("w_hash")), "left")
    at = F.filter(F.sequence("from", "upto"), lambda i: F.slice("ws", i + 1, F.size("span")) == F.col("span"))
    extended = F.when(F.col("from") == -1, F.array(F.lit(-1))).otherwise(at)
    matched = joined.where((F.col("from") == -1) | F.col("span").isNotNull()).select("id", "h", F.size("ws").cast("long").alias("n_words"), "item", F.size("span").alias("length"), F.explode(extended).alias("start"))
    found = matched.select("id", "h", "n_words", "start", F.when(F.col("start") >= 0, F.struct("start", "length")).alias("s"), "item")
    return found.groupBy("id", "h").agg(
        F.sum(F.when(F.col("start") == -1, 1).otherwise(0)).alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("item")).alias("items"),
        F.array_sort(F.collect_set("s")).alias("spans"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, text_hash, n_words, n_hit, items, contaminated for each row of docs.

    A word inside any occurrence of a benchmark window is hit; n_hit counts each
    word once. contaminated: n_hit > 0 and 20 * n_hit >= n_words. items holds the
    ids of the items with occurring windows, as ascending strings.

    A null or empty text has no words and is not contaminated. Repeated rows come
    back as often as they are there. An empty benchmark hits nothing. text_hash is
    xxhash64 of the text, which tells texts of one id apart. Other columns are not
    read.
    """
    found = occurrences(docs, benchmark, key, text, item, item_text, window, gram)
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))
    count = F.aggregate(
        "spans",
        none,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("hit"),
            F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
        ),
        lambda a: a["hit"],
    )
    counted = found.select("id", "h", "n_rows", "n_words", "items", count.alias("n_hit"))
    judged = counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    repeated = judged.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int"))))
    return repeated.select(F.col("id").alias(key), F.col("h").alias("text_hash"), "n_words", "n_hit", "items", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs without the contaminated rows; columns as in docs.

    Only the keys of contaminated rows are joined back. Rows of one null key are
    compared by their text alone.
    """
    bad = contamination(docs, benchmark, key, text, **limits).where("contaminated").select(F.col(key).alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_bad_hash")), "left_anti")
