"""Document fingerprints: MinHash over five-word shingles, in vectorised numpy.

A signature holds, for each of K universal hash permutations of 32-bit shingle
hashes, the smallest value over a text's shingles; two signatures agree in a
share of places that estimates the Jaccard similarity of the shingle sets. Bands of
signatures are joined in Spark, and the Jaccard similarity of candidates is verified
on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import links, neardup, vectors
from sluice.llm.store import Scratch, materialize, release

#: 24 bands of 5 hashes: texts of a similarity of 0.8 share none in 0.007% of cases.
HASHES, BANDS, ROWS, WORDS, SIMILARITY = 128, 24, 5, 5, 0.8
_A = (vectors.stream(11, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (vectors.stream(12, HASHES) >> np.uint64(32)).astype(np.uint32)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (texts x HASHES, 32-bit) and which texts have words.

    Each permutation is x -> a x + b mod 2^32 with odd a. Texts without words
    have signatures of zeros.
    """
    data, offsets = vectors.raw(texts)
    out = np.zeros((len(offsets) - 1, HASHES), np.uint32)
    some = np.zeros(len(offsets) - 1, bool)
    for first, end, part, at in vectors.groups(data, offsets):
        hashes, places = vectors.shingles(*vectors.word_hashes(part, at), WORDS)
        full = np.flatnonzero(np.diff(places))
        if not len(full):
            continue
        x, starts = (hashes >> np.uint64(32)).astype(np.uint32), places[full]
        some[first + full] = True
        least = np.empty((HASHES, len(full)), np.uint32)
        for k in range(HASHES):
            np.minimum.reduceat(x * _A[k] + _B[k], starts, out=least[k])
        out[first + full] = least.T
    return out, some


def short(signature: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Eight mixed bits of each place: what a fingerprint string shows."""
    mixed = (signature ^ (signature >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.where(some[:, None], (mixed >> np.uint32(24)).astype(np.uint8), np.uint8(0))


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of short signatures, row by row.

    Different values agree in their eight bits once in 256 times, which is taken
    off. Two texts without words are alike (1), one without and one with not (0).
    """
    agree = (a == b).mean(axis=1)
    return np.where(a_some & b_some, np.maximum(0.0, (agree - 1 / 256) / (1 - 1 / 256)), (a_some == b_some).astype(float))


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h, body, tail in partitions sorted so that each row's next document follows it.

    Next is the row with the next lower key (then by h, the text's hash; null keys
    come last); the last row's next is the first. Rows are dealt by ranges of key and
    hash, so that a repeated or null key is no single range; each range also gets
    the first rows of the next one, marked tail and sorted last.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    order = [F.col("id").isNull().cast("int").alias("nil"), F.coalesce(F.bitwise_not("id"), F.lit(0).cast("bigint")).alias("down"), F.col("h")]
    # One row for each range, its first: as many as there are shuffle partitions.
    ranged = rows.select(*order).repartitionByRange(n, "nil", "down", "h")
    bounds = sorted(tuple(r[0]) for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("nil", "down", "h")).alias("low")).select("low").collect())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [*zip(*(batch.column(i).to_pylist() for i in (3, 4, 1)), strict=True)]
            to = [bisect_right(bounds, x) - 1 for x in at]
            tails = [i for i, (x, b) in enumerate(zip(at, to, strict=True)) if x == bounds[b]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * len(at)), pa.array(to, pa.int32())], [*batch.schema.names, "tail", "bucket"])
            if tails:
                ends = [(to[i] or len(bounds)) - 1 for i in tails]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(tails)).columns, pa.array([True] * len(tails)), pa.array(ends, pa.int32())], [*batch.schema.names, "tail", "bucket"])

    dealt = rows.select("id", "h", "body", *order[:2]).mapInArrow(deal, "id bigint, h bigint, body string, nil int, down bigint, tail boolean, bucket int")
    return dealt.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("tail", "nil", "down", "h").select("id", "h", "body", "tail")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text has its last floor(n_chars / 3) characters replaced by the
    first as many (or all) of the next document's; next as in neighbours(). A
    null text is empty; a text without words has a fingerprint of zeros. Equal
    texts have equal fingerprints. class_id is the smallest key of the documents
    that are linked to this one by a shared band of their signatures and a Jaccard
    similarity of `similarity` or more (null only if none has a key). Repeated rows
    follow each other and come back as often. An empty table gives no rows; other
    columns are not read. Keys are cast to bigint; one that is no number is an error
    under ANSI.
    """
    with Scratch(docs.sparkSession) as scratch:
        # As rows(): null is the empty text, so that a text has one hash.
        texts = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
        rows, facts = links.clusters(texts, *METHOD, key="id", text="body", similarity=similarity, scratch=scratch)
        linked = materialize(links.followers(rows, facts), "linked")
    del rows, facts
    release(docs.sparkSession)
    schema = "id bigint, h bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ended = False
        for batch in batches:
            for some in range(0, batch.num_rows, 1024):
                part = batch.slice(some, 1024)
                ids, hashes, texts, tails = (part.column(i).to_pylist() for i in range(4))
                signature, words = signatures(part.column(2))
                marks = short(signature, words)
                if held:
                    ids, hashes, texts, tails = [held[0], *ids], [held[1], *hashes], [held[2], *texts], [False, *tails]
                    marks, words = np.vstack([held[3][None], marks]), np.append(held[4], words)
                last = next((i for i, t in enumerate(tails) if t), None)
                upto = len(ids) - 1 if last is None else last
                if ended or upto < 1 and last is None:
                    if not ended:
                        held = ids[-1], hashes[-1], texts[-1], marks[-1], words[-1]
                    continue
                ended = last is not None
                edited = []
                for i in range(upto):
                    n = len(texts[i])
                    edited.append(texts[i][: n - n // 3] + texts[i + 1][: n // 3])
                e_signature, e_words = signatures(pa.array(edited, pa.string()))
                e_marks = short(e_signature, e_words)
                own, own_words, after, after_words = marks[:upto], words[:upto], marks[1 : upto + 1], words[1 : upto + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:upto], pa.int64()),
                        pa.array(hashes[:upto], pa.int64()),
                        pa.array([len(t) for t in texts[:upto]], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).digest() for e in edited], pa.binary()),
                        _bytes(own),
                        _bytes(e_marks),
                        pa.array(likeness(own, own_words, e_marks, e_words), pa.float64()),
                        pa.array(likeness(own, own_words, after, after_words), pa.float64()),
                    ],
                    ["id", "h", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                held = None if ended else (ids[-1], hashes[-1], texts[-1], marks[-1], words[-1])

    found = materialize(neighbours(docs, key, text).mapInArrow(run, schema), "fingerprints")
    release(docs.sparkSession)
    linked = linked.select(F.col("id").alias("l_id"), F.col("h").alias("l_h"), "first")
    joined = found.join(linked, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")), "left")
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return joined.select(F.col("id").alias(key), "n_chars", *map(text_of, ("edited_sha256", "fingerprint", "edited_fingerprint")), "near_edited", "near_next", F.when(F.col("l_h").isNull(), F.col("id")).otherwise(F.col("first")).alias("class_id"))


def banded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each set of shingles, and the band hashes of each signature."""
    signature, some = signatures(texts)
    nodes = np.concatenate([links.digests(h, p) for h, p in sets(texts)] or [np.zeros(0, np.uint64)])
    return nodes, np.where(some[:, None], links.band(signature[:, : BANDS * ROWS], BANDS), np.uint64(0))


def features(texts: pa.Array) -> list[np.ndarray]:
    return [h[a:b] for h, p in sets(texts) for a, b in zip(p[:-1], p[1:], strict=True)]


def sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, sorted, and where each text's start."""
    for _, places, hashes, _ in neardup.bags(texts):
        yield hashes, places


def jaccard(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sets of sorted distinct shingle hashes have a Jaccard similarity of `similarity` or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and shared >= similarity * (len(a) + len(b) - shared)


def shortlist(one: list[np.ndarray], two: list[np.ndarray], similarity: float) -> list[list[int]]:
    """The places of the pairs of sets whose Jaccard similarity is about `similarity` or more."""
    a, b = (np.array([len(x) for x in side], float) for side in (one, two))
    both = links.shared(*([(x, np.ones(len(x))) for x in side] for side in (one, two)))
    return np.argwhere((both > 0) & (both * (1 + 1e-4) >= similarity * (a[:, None] + b[None] - both))).tolist()


#: What links.clusters needs.
METHOD = banded, features, jaccard, shortlist
