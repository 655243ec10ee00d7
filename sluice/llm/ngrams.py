"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980).

P(w | h) mixes maximum-likelihood estimates: of the bigram, c(h, w) / c(h), of
the word, c(w) / N, and of any word, 1 / (V + 1). The weights depend on how often
the context h was seen (buckets of powers of two) and are learned by
expectation-maximisation on counts of a part of the training texts that was left
out of (deleted from) the counts. Scores use the counts of all training texts.

Counting without a row for each token: the texts of one input partition make a
block. A block sends its distinct word and bigram hashes, sorted and packed,
with its own counts; shards of the hash space add the counts up and answer every
block with the totals in the order it asked. Scoring meets each block's texts
again with its answers. So what is shuffled grows with the input, no hash is
looked up more than once a block, and nothing is collected but sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.llm import vectors
from sluice.llm.store import materialize, release

U64 = np.uint64
END, START = vectors.stream(31, 2)
#: Context buckets: unseen, then by powers of two. Probabilities that the weights are
#: learned from are rounded to a STEPS-th of a decade, GRID steps in all, so that what
#: the driver gets is bounded; scores use them as they are.
CONTEXTS, STEPS, GRID = 24, 32, 384


def fold(key: Column) -> Column:
    """The fold of a row by its key's text: 2 is held out of training, 3 deleted from the counts."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)).cast("int"), F.lit(2))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each closed by END, and where each text's start."""
    data, offsets = vectors.raw(texts)
    parts, counts = [], []
    for _, _, part, at in vectors.groups(data, offsets):
        words, upto = vectors.word_hashes(part, at, vectors.UNSPACED)
        parts.append(np.insert(words, upto[1:], END))
        counts.append(np.diff(upto) + 1)
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


def bigrams(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it (START before a text's first)."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[starts[:-1]] = START
    with np.errstate(over="ignore"):
        return vectors.mix(before * U64(0x9E3779B97F4A7C15) + flat)


def _blocks(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """block, fold, id, body: texts of an input partition are `parts` blocks, and as many of the deleted fold."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"), fold(F.col(key)).alias("fold"))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)) + F.when(F.col("fold") == 3, parts).otherwise(0)
    return rows.select((F.spark_partition_id().cast("long") * (2 * parts) + part).alias("block"), "fold", "id", "body")


def _ask(shards: int):
    """Blocks to rows of (shard, block, kind, hashes, counts): kind 0 has words, 1 bigrams; counts are those in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for batch in batches:
            block, folds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for b, f in {*zip(block.tolist(), (folds == 2).tolist(), strict=True)}:
                mine = batch.filter(pa.array((block == b) & ((folds == 2) == f)))
                for first in range(0, mine.num_rows, 2048):
                    flat, starts = tokens(mine.column(3).slice(first, 2048))
                    held.setdefault((b, 0, f), []).append(flat)
                    held.setdefault((b, 1, f), []).append(bigrams(flat, starts))
        cuts = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(U64)
        for b, kind in sorted({(b, kind) for b, kind, _ in held}):
            train = np.concatenate(held.pop((b, kind, False), [np.zeros(0, U64)]))
            other = np.concatenate(held.pop((b, kind, True), [np.zeros(0, U64)]))
            train, times = np.unique(train, return_counts=True)
            hashes = np.union1d(train, other)
            count = np.zeros(len(hashes), np.int32)
            count[np.searchsorted(hashes, train)] = times
            del train, other, times
            at = [0, *np.searchsorted(hashes, cuts), len(hashes)]
            rows = [(s, at[s], at[s + 1]) for s in range(shards) if at[s + 1] > at[s]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _, _ in rows], pa.int32()), pa.array([b] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()),
                    pa.array([hashes[i:j].tobytes() for _, i, j in rows], pa.binary()), pa.array([count[i:j].tobytes() for _, i, j in rows], pa.binary()),
                ],
                ["shard", "block", "kind", "hashes", "counts"],
            )

    return run


def _answer(parts: int):
    """Rows of one shard and kind to (block, shard, kind, wide, all, kept), and the shard's sums as block -1.

    Counts have 64 bits where wide, else 32, which all of the shard's fit into.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, kind = key[0].as_py(), key[1].as_py()
        blocks = table["block"].to_pylist()
        hashes = [np.frombuffer(x.as_py(), U64) for x in table["hashes"]]
        counts = [np.frombuffer(x.as_py(), np.int32) for x in table["counts"]]
        every, places = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.concatenate(counts)
        kept = count * np.repeat([b % (2 * parts) < parts for b in blocks], [len(h) for h in hashes])
        every_all = np.bincount(places, count, len(every)).astype(np.int64)
        every_kept = np.bincount(places, kept, len(every)).astype(np.int64)
        ends = np.cumsum([0, *map(len, hashes)])
        wide = kind == 0 or every_all.max() > 0x7FFFFFFF
        low = lambda v: v.astype(np.int64 if wide else np.int32).tobytes()
        rows = [(b, shard, kind, wide, low(every_all[places[i:j]]), low(every_kept[places[i:j]])) for b, i, j in zip(blocks, ends[:-1], ends[1:], strict=True)]
        sums = np.array([every_all.sum(), (every_all > 0).sum(), every_kept.sum(), (every_kept > 0).sum()], np.int64)
        rows.append((-1, shard, kind, True, sums.tobytes(), b""))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "shard", "kind", "wide", "all", "kept"), zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)})

    return run


class Block:
    """One block's texts with the counts that its shards answered.

    Iterating gives some texts at a time, so that only the hashes of the whole
    block are held, not all figures of all its tokens.
    """

    def __init__(self, texts: pa.ChunkedArray, answers: pa.Table, counts: str):
        """counts: the column of answers that is used, all or kept (without the deleted fold)."""
        self.pieces = [c.slice(i, 1024) for c in texts.chunks for i in range(0, len(c), 1024)]
        self.words, self.pairs = np.zeros(0, U64), np.zeros(0, U64)
        for some in range(0, len(self.pieces), 4):
            found = [tokens(p) for p in self.pieces[some : some + 4]]
            self.words = np.unique(np.concatenate([self.words, *(f for f, _ in found)]))
            self.pairs = np.unique(np.concatenate([self.pairs, *(bigrams(f, s) for f, s in found)]))
        order = np.lexsort((answers["shard"].to_numpy(), answers["kind"].to_numpy()))
        kinds, wide, column = answers["kind"].to_numpy()[order], answers["wide"].to_numpy()[order], answers[counts]
        got = lambda kind: np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(column[int(i)].as_buffer(), np.int64 if w else np.int32) for i, k, w in zip(order, kinds, wide, strict=True) if k == kind)])
        self.word, self.pair = got(0), got(1)
        if len(self.word) != len(self.words) or len(self.pair) != len(self.pairs):
            raise ValueError("a block's texts differ from those that were counted; write the input to a table first")

    def parts(self, n_texts: int):
        """For some texts at a time: starts, and for each token its count, its bigram's and
        its context's; n_texts is how many texts were counted."""
        for piece in self.pieces:
            flat, starts = tokens(piece)
            word = self.word[np.searchsorted(self.words, flat)]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[starts[:-1]] = n_texts
            yield starts, word, self.pair[np.searchsorted(self.pairs, bigrams(flat, starts))], context


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)), CONTEXTS - 1).astype(np.int64)


def expectation_maximisation(cells: np.ndarray, unknown: float, rounds: int = 60) -> np.ndarray:
    """CONTEXTS x 3 weights (bigram, word, any) from rows (bucket, bigram step, word step, count).

    Steps are logarithms to the base of 10 in STEPS-ths, GRID - 1 for a probability
    of 0. Buckets that were not met take the mean of all.
    """
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if not len(cells):
        return weights
    b, count = cells[:, 0], cells[:, 3].astype(float)
    p = np.stack([*(np.where(cells[:, i] == GRID - 1, 0.0, 10.0 ** (-cells[:, i] / STEPS)) for i in (1, 2)), np.full(len(cells), unknown)], axis=1)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (count / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(b, share[:, i], CONTEXTS) for i in range(3)], axis=1)
        # A little of the mean keeps rare buckets, and every weight above 0.
        mean = (sums[1:].sum(axis=0) + 1) / (sums[1:].sum() + 3)
        weights = (sums + mean) / (sums.sum(axis=1, keepdims=True) + 1)
        weights[0, 0] = 0
        weights[0] /= weights[0].sum()
    return weights


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens are runs of other than blanks, A-Z lower-cased, and an end after each
    text; a null or empty text has the end alone. Rows of fold 2 are held out;
    null keys too. base_score adds up log10((c + 1) / (N + V + 1)) with the
    training counts; score is log10 of the interpolated model's probability, whose
    estimates come from all training texts (its weights from those but fold 3, and
    fold 3). Both have every token; n_known counts those with c > 0.

    docs is read once for counting and once for scoring and has to give the same
    partitions both times, as a table does; a difference is an error, not a wrong
    score. parts: blocks of an input partition, from its size if not given. An
    empty table gives no rows; other columns are not read. Keys can be of any type
    that Arrow has; repeated ones keep their own texts.
    """
    spark = docs.sparkSession
    if parts is None:
        size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        parts = max(1, math.ceil(size / (8 << 20)))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, key, text, parts)
    asked = blocks.mapInArrow(_ask(shards), "shard int, block bigint, kind int, hashes binary, counts binary")
    answers = materialize(asked.groupBy("shard", "kind").applyInArrow(_answer(parts), "block bigint, shard int, kind int, wide boolean, all binary, kept binary"), "answers")
    del asked
    release(spark)
    sums = {0: np.zeros(4, np.int64), 1: np.zeros(4, np.int64)}
    for row in answers.where("block = -1").select("kind", "all").collect():  # one row for each shard and kind
        sums[row["kind"]] = sums[row["kind"]] + np.frombuffer(row["all"], np.int64)
    n, v, n_kept, v_kept = (int(x) for x in sums[0])
    texts_all, texts_kept = (docs.where(~fold(F.col(key)).isin(*left)).count() for left in ((2,), (2, 3)))
    answers = answers.where("block >= 0").withColumnRenamed("block", "a_block")

    def observe(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.zeros(CONTEXTS * GRID * GRID, np.int64)
        step = lambda p: np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, GRID - 2), GRID - 1).astype(np.int64)
        if left.num_rows:
            for _, kept, pair, context in Block(left["body"], right, "kept").parts(texts_kept):
                cell = (bucket(context) * GRID + step(pair / np.maximum(context, 1))) * GRID + step(kept / max(1, n_kept))
                counts += np.bincount(cell, minlength=len(counts))
        cells = np.flatnonzero(counts)
        columns = cells // GRID**2, cells // GRID % GRID, cells % GRID, counts[cells]
        return pa.table({c: x.astype(np.int64) for c, x in zip(("b", "p2", "p1", "n"), columns, strict=True)})

    deleted = blocks.where("fold = 3").select("block", "body")
    wanted = answers.where(F.pmod("a_block", F.lit(2 * parts)) >= parts).drop("all")
    seen = deleted.groupBy("block").cogroup(wanted.groupBy("a_block")).applyInArrow(observe, "b bigint, p2 bigint, p1 bigint, n bigint")
    cells = seen.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).toArrow()  # at most CONTEXTS x GRID x GRID rows
    cells = np.stack([cells[c].to_numpy() for c in ("b", "p2", "p1", "n")], axis=1) if cells.num_rows else np.zeros((0, 4), np.int64)
    del seen
    release(spark)
    weights = expectation_maximisation(cells[np.lexsort(cells.T)], 1 / (v_kept + 1))
    kind = docs.schema[key].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = (key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        if not left.num_rows:
            return pa.table(dict.fromkeys(names, pa.array([]))).cast(target)
        sums: tuple[list, ...] = ([], [], [], [])
        for starts, word, pair, context in Block(left["body"], right, "all").parts(texts_all):
            mix = weights[bucket(context)]
            p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (word / max(1, n)) + mix[:, 2] / (v + 1)
            found = np.diff(starts), *(np.add.reduceat(x, starts[:-1]) for x in ((word > 0).astype(np.int64), np.log10((word + 1) / (n + v + 1)), np.log10(p)))
            for out, x in zip(sums, found, strict=True):
                out.append(x)
        sizes, known, base, scored = map(np.concatenate, sums)
        columns = (left["id"], left["fold"].to_numpy() == 2, sizes, known, np.full(len(sizes), n), base, scored)
        return pa.table(dict(zip(names, columns, strict=True))).cast(target)

    target = pa.schema([(key, to_arrow_type(docs.schema[key].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.drop("kept").groupBy("a_block")).applyInArrow(score, schema)
