"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

A lexicon of words and word beginnings is learned from labelled texts. Features
are the lexicon's densities, how near its words stand to second-person words,
and rates of capitals, punctuation and obfuscation. Lexicon, trees and
calibration are learned on three separate parts of a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import kept
from sluice.llm.store import materialize
from sluice.llm.trees import Boosted, Isotonic

#: Labelled rows learned from, at most (by a hash of the key); entries of the lexicon, at most; the score from which a text counts as toxic.
SAMPLE, LEXICON, THRESHOLD = 30_000, 2_000, 0.3
STEMS = (6, 5, 4)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"\w+")
#: Only from where a run of such characters begins, so that a long run is read once.
_MASKED = re.compile(r"(?<![\w@$*!|+.\-])\w*[@$*!0-9|+.\-_]+\w[\w@$*!|+.\-]*")
_PLAIN = str.maketrans("@$!|0134578+", "asiioieastbt", "*.-_")
_LOUD = re.compile(r"[!?]{2,}")
_SHOUT = re.compile(r"\b[A-ZÀ-Þ]{2,}\b")
FEATURES = 18


def learnable(key: Column) -> Column:
    """Whether labels of this row may be learned from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) != 2


def terms(text: str) -> set[str]:
    """The words of a text and, after a bar, the beginnings of the longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | {"|" + w[:k] for w in words for k in STEMS if len(w) > k}


def _stem(word: str, lexicon: dict[str, float]) -> str:
    """The longest beginning of a word that the lexicon holds; else an empty string."""
    for k in STEMS:
        if len(word) > k and (found := "|" + word[:k]) in lexicon:
            return found
    return ""


def features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """texts x FEATURES; all zeros but the first two columns for an empty text."""
    out = np.zeros((len(texts), FEATURES))
    for row, text in zip(out, texts, strict=True):
        low = text.lower()
        words = _WORD.findall(low)
        n, chars = len(words), max(1, len(text))
        full = [i for i, w in enumerate(words) if w in lexicon]
        known = {w: f for w in set(words) if (f := _stem(w, lexicon))}
        stems = [i for i, w in enumerate(words) if w in known] if known else []
        weights = [lexicon[words[i]] for i in full] + [lexicon[known[words[i]]] for i in stems]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        masked = [m.strip(".-_!") for m in _MASKED.findall(low)] if n else []
        masked = [m for m in masked if not m.isalnum() or not m.isdigit()]
        plain = [p for p in (m.translate(_PLAIN) for m in masked if not m.isalpha()) if p in lexicon or _stem(p, lexicon)]
        hits = sorted({*full, *stems})
        near = 0
        if hits and you:
            at, of = np.array([-9, *you, n + 9]), np.array(hits)
            after = np.searchsorted(at, of)
            near = int((np.minimum(at[after] - of, of - at[after - 1]) <= 5).sum())
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        marks = chars - sum(map(len, words)) - text.count(" ") - text.count("\n") if n else 0
        shout = _SHOUT.findall(text)
        per = 100 / max(1, n)
        row[:] = [
            np.log1p(n), np.log1p(chars), len(full) * per, len(stems) * per, len(hits), len({words[i] for i in hits}),
            max(weights, default=0), sum(weights) * per, near * per, len(you) * per, upper / chars, len(shout) * per,
            marks / chars, text.count("!") / chars, len(_LOUD.findall(text)) * per, len(plain) * per, len(plain), sum(not m.isalnum() for m in masked) * per,
        ]
    return out


class Model:
    """What is sent to the workers: a lexicon, trees and steps, all of bounded size."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, steps: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.steps, self.rate = lexicon, trees, steps, rate

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        margin = self.trees.margin(features(texts, self.lexicon))
        # Within a step the margin still orders rows.
        return np.clip(self.steps(margin) + 1e-4 / (1 + np.exp(-margin)), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the learnable labelled rows, `sample` at most.

    Rows without a label, or whose key repeats with another label, are left out; of
    documents with equal keys the one with the least text counts. Without both kinds
    of label the model gives every text their share (0 if there is none).
    """
    known = labels.where(F.col(label).isNotNull() & learnable(F.col(key))).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    total = known.count()
    if not total:
        return Model({}, None, None, 0.0)
    order = F.xxhash64(F.lit("sample"), F.col(key))
    picked = known.withColumn("o", order).where(F.pmod("o", F.lit(1_000_000)) < 1_000_000 * sample / total).orderBy("o").limit(sample)
    picked = picked.select(F.col(key).alias("l_id"), F.col("y").cast("int").alias("y"), F.pmod("o", F.lit(97)).cast("int").alias("part"))
    # The sample is bounded, so it can be broadcast. Its texts are read and written once.
    labelled = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).join(F.broadcast(picked), F.col("id") == F.col("l_id"))
    rows = materialize(labelled.groupBy("l_id", "y", "part").agg(F.min("body").alias("body")).select("y", "part", "body"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, part, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part < 40:
                    seen[y > 0].update(terms(body))
                    seen[y > 0][""] += 1
            words = list({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["term", "bad", "good"])

    counted = rows.mapInArrow(count, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = materialize(counted.where("bad >= 3 or term = ''"), "terms")
    ends = counted.where("term = ''").collect()
    bad, good = (ends[0]["bad"], ends[0]["good"]) if ends else (0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = counted.where("term != ''").withColumn("odds", odds).where("odds >= 2").orderBy((F.col("bad") * F.col("odds")).desc(), "term").limit(LEXICON).collect()
    lexicon = {r["term"]: r["odds"] for r in top}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            x = features(batch.column(2).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["y", "part", "x"])

    found = rows.where("part >= 40").mapInArrow(measure, "y int, part int, x array<double>").toArrow()
    y, part = found["y"].to_numpy(), found["part"].to_numpy()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, part, y))  # the same model, whatever order rows come in
    x, y, part = x[order], (y[order] > 0).astype(float), part[order]
    fit = part < 80
    if len({*y[fit]}) < 2 or len({*y[~fit]}) < 2:
        return Model({}, None, None, float(y.mean()) if len(y) else 0.0)
    trees = Boosted().fit(x[fit], y[fit])
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[~fit]), y[~fit]), float(y.mean()))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row of docs.

    A null text counts as empty and is scored like one. Rows stay in their
    partitions; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = model.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, docs[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
    return found.select(key, F.coalesce(~learnable(F.col(key)), F.lit(False)).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that count as toxic; columns as in docs."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = model.score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
