"""MinHash near-deduplication: improved consistent weighted sampling over TF-IDF shingles.

A text is a bag of five-word shingles with weights (1 + DAMP ln tf) x idf. A sample
picks the shingle with the smallest a = c / (y e^r), where r and c are
Gamma(2, 1) and beta uniform by shingle and sample, t = floor(ln w / r + beta) and
y = e^(r (t - beta)); two texts pick the same (shingle, t) with a probability
equal to their weighted Jaccard similarity (Ioffe, 2010). Bands of samples give
candidates, which the weighted Jaccard similarity itself verifies.

Both weights are damped: idf lies between 1 and 1 + LIFT. So the weighted similarity
stays within a few hundredths of that of the plain sets, and neither a passage that
many texts share nor a text that is repeated within itself hides a near copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kept, links, vectors
from sluice.llm.store import Scratch, materialize, read_bytes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Shingles in fewer than one text in RARE all have the largest idf; the largest is LIFT above 1.
RARE, LIFT, DAMP = 1000, 0.1, 0.05
#: Shingles that a partition counts at a time; entries of the table of frequent shingles, at most.
HELD, TABLE = 1_500_000, 1_000_000
#: Stored bytes that one task counts, about at least and at most; between them there is a task for each core.
COUNTED = 4 << 20, 32 << 20
SAMPLES = BANDS * ROWS
U32, U64 = np.uint32, np.uint64

#: Random variates by 16 hashed bits; each sample permutes the shingles differently.
_SIZE = 1 << 16
_random = np.random.Generator(np.random.PCG64(2010))
_R = _random.gamma(2.0, 1.0, _SIZE)
_LNC = np.log(_random.gamma(2.0, 1.0, _SIZE))
_BETA = _random.random(_SIZE)
_A = (vectors.stream(21, SAMPLES) >> U64(32)).astype(U32) | U32(1)
_B = (vectors.stream(22, SAMPLES) >> U64(32)).astype(U32)
_TOP = 1 + LIFT


def _ln_a(at: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
    """ln a as sortable 32-bit numbers in the high half of 64."""
    r, beta = _R[at], _BETA[at]
    t = np.floor(ln_w / r + beta)
    bits = (_LNC[at] - r * (t - beta) - r).astype(np.float32).view(U32)
    return np.where(bits >> U32(31), ~bits, bits | U32(1 << 31)).astype(U64) << U64(32)


_BASE = _ln_a(np.arange(_SIZE), np.full(_SIZE, np.log(_TOP)))


class Idf:
    """idf by shingle: 1 + LIFT ln(n / df) / ln rare, df at least n / rare.

    The table holds the sorted hashes of the shingles in more than one text in
    rare, fewer than rare x the mean number of shingles of a text.
    """

    def __init__(self, n: int, hashes: np.ndarray, df: np.ndarray, rare: float = RARE):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = 1 + LIFT * np.log(np.clip(n / np.maximum(df[order], 1), 1, rare)) / np.log(rare)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), _TOP)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.values[at[known]]
        return out


def bags(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """first, places, hashes, tf for groups of texts: the distinct shingles of each, sorted."""
    data, offsets = vectors.raw(texts)
    for first, end, part, at in vectors.groups(data, offsets):
        hashes, places = vectors.shingles(*vectors.word_hashes(part, at), WORDS)
        owner = np.repeat(np.arange(end - first), np.diff(places))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        yield first, np.searchsorted(owner[at], np.arange(end - first + 1)), hashes[at], np.diff(at, append=len(hashes))


def weights(hashes: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    """The TF-IDF weights of shingles; 1 + LIFT for one that is rare and met once."""
    return (1 + DAMP * np.log(tf)) * idf(hashes)


def rarity(n: int, total: int) -> float:
    """RARE, or as much less as makes the shingles that are in more than one text in it TABLE at most."""
    return min(RARE, max(2.0, TABLE * n / max(1, total)))


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, df, kind of one partition's texts by lossy counting: what can be in more than
    n / rarity(n, all its shingles) of its n texts, each df short by at most a quarter of that.

    kind is 0 for a shingle, 1 for the number of texts and 2 for that of all shingles.
    """
    kept.let_go()
    n, total, cut, seen, times, missed = 0, 0, 0, np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    for batch in batches:
        n += batch.num_rows
        for _, _, hashes, _ in bags(batch.column(0)):
            total += len(hashes)
            new, more = np.unique(hashes, return_counts=True)
            at = np.searchsorted(seen, new)
            known = at < len(seen)
            known[known] = seen[at[known]] == new[known]
            times[at[known]] += more[known].astype(np.int32)
            at, fresh = at[~known], ~known
            seen, times, missed = np.insert(seen, at, new[fresh]), np.insert(times, at, more[fresh].astype(np.int32)), np.insert(missed, at, cut)
            if len(seen) > HELD:  # what is rare so far is let go; missed is what an entry can have lost before it came
                cut = int(n / (4 * rarity(n, total)))
                keep = times + missed > cut
                seen, times, missed = seen[keep], times[keep], missed[keep]
    keep = (times + missed) * rarity(n, total) > n
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen[keep].view(np.int64), [0, 0])), pa.array(np.append(times[keep].astype(np.int64), [n, total])), pa.array(np.append(np.zeros(keep.sum(), np.int32), np.array([1, 2], np.int32)))], ["hash", "df", "kind"])


def idf(docs: DataFrame, text: str = "text") -> Idf:
    """Document frequencies over all of docs, to within one text in RARE and a TABLE-th of all shingles.

    A shingle in more than n / r of all texts is in more than m / r of the m texts of
    some partition, so each partition sends only those; what the others hold back is
    less than the sum of their m / r. A partition of few texts would send most of its
    shingles, so neighbouring partitions are counted as one, however small the table's
    splits are.
    """
    least, most = COUNTED
    read = read_bytes(docs)
    tasks = max(1, math.ceil(read / most), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(read / least)))
    sent = docs.select(F.col(text).cast("string")).coalesce(min(tasks, (1 << 31) - 1)).mapInArrow(frequencies, "hash bigint, df bigint, kind int")
    sums = materialize(sent.groupBy("hash", "kind").agg(F.sum("df").alias("df")), "frequencies")
    totals = {r["kind"]: r["df"] for r in sums.where("kind > 0").collect()}  # two rows
    n = totals.get(1, 0)
    rare = rarity(n, totals.get(2, 0))
    found = sums.where((F.col("kind") == 0) & (F.col("df") * rare > n)).select("hash", "df").toArrow()
    return Idf(n, found["hash"].to_numpy().view(U64), found["df"].to_numpy(), rare)


def samples(hashes: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """texts x SAMPLES: the (a, shingle) picked by each sample, for texts that have shingles."""
    x = (hashes >> U64(32)).astype(U32)
    other = np.flatnonzero(weights != _TOP)
    ln_w, x_other, low = np.log(weights[other]), x[other], x.astype(U64)
    starts = places[:-1]
    out = np.empty((SAMPLES, len(starts)), U64)
    for k in range(SAMPLES):
        value = _BASE[(x * _A[k] + _B[k]) >> U32(16)]
        if len(other):
            value[other] = _ln_a((x_other * _A[k] + _B[k]) >> U32(16), ln_w)
        value |= low
        np.minimum.reduceat(value, starts, out=out[k])
    return out.T


def alike(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float], similarity: float) -> bool:
    """Whether two bags (sorted hashes, weights, their sum) have a weighted Jaccard
    similarity of `similarity` or more."""
    (x, v, v_sum), (y, w, w_sum) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if not len(y) or min(v_sum, w_sum) < (similarity - 1e-9) * max(v_sum, w_sum):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    shared = np.minimum(v[at[same]], w[same]).sum()
    return bool(shared >= (similarity - 1e-12) * (v_sum + w_sum - shared))


def shortlist(one: list, two: list, similarity: float) -> list[list[int]]:
    """The places of all pairs of bags that can be alike, and of few others.

    The smaller of two weights is at most the root of their product, and equal to
    it where they are equal.
    """
    a, b = (np.array([total for _, _, total in side], float) for side in (one, two))
    both = links.shared(*([(h, np.sqrt(w)) for h, w, _ in side] for side in (one, two)))
    return np.argwhere((both > 0) & (both * (1 + 1e-4) >= similarity * (a[:, None] + b[None] - both))).tolist()


def method(docs: DataFrame, text: str = "text") -> tuple:
    """What links.clusters needs: bands, features, alike and shortlist with the weights of docs."""
    table = docs.sparkSession.sparkContext.broadcast(idf(docs, text))

    def bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nodes, hashed = np.zeros(len(texts), U64), np.zeros((len(texts), BANDS), U64)
        for first, places, hashes, tf in bags(texts):
            full = np.flatnonzero(np.diff(places))
            with np.errstate(over="ignore"):
                nodes[first : first + len(places) - 1] = links.digests(vectors.mix(hashes) + tf.astype(U64), places)
            if len(full):
                hashed[first + full] = links.band(samples(hashes, weights(hashes, tf, table.value), np.append(places[full], len(hashes))), BANDS)
        return nodes, hashed

    def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, float]]:
        out = []
        for _, places, hashes, tf in bags(texts):
            w = weights(hashes, tf, table.value)
            out += [(hashes[a:b], w[a:b], float(w[a:b].sum())) for a, b in zip(places[:-1], places[1:], strict=True)]
        return out

    return bands, features, alike, shortlist


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, class_id, copy_of, class_node for every row of docs; see links.classes.

    Texts are near duplicates at a weighted Jaccard similarity of `similarity` or
    more; classes are the connected components.
    """
    return links.classes(docs, *method(docs, text), key=key, text=text, similarity=similarity)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate class: that of its smallest key.

    Null keys come after all others, equal keys in the order of a hash of their
    texts. Of rows that repeat both key and text any one stays. Columns are those of
    docs.
    """
    names = ("_near_id", "_near_h")
    with Scratch(docs.sparkSession) as scratch:
        rows, facts = links.clusters(docs, *method(docs, text), key=key, text=text, similarity=similarity, scratch=scratch)
        gone = materialize(links.followers(rows, facts).select("id", "h").toDF(*names), "gone")
        again = materialize(rows.groupBy("id", "h").count().where("count > 1").select("id", "h").toDF(*names), "again")
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_near_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_near_h"))
    kept = docs.join(gone, same, "left_anti")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, same, "left_anti")
    return once.unionByName(kept.join(again, same).dropDuplicates(list(names)).select(*docs.columns))
