"""Cases that a cut in an operator would lose."""

import random
import weakref
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

import plain

tokenizers = pytest.importorskip("public_tokenizers")
from sluice.llm import bpe, links, neardup, ngrams, vectors  # noqa: E402
from sluice.llm.store import materialize  # noqa: E402


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def test_links_of_a_large_mixed_bucket(spark, monkeypatch):
    """All nodes share one band only; pairs are alike, and unlike any leader."""
    rnd = random.Random(1)
    docs = []
    for i in range(400):
        own = [f"w{rnd.randint(0, 10**9)}" for _ in range(40)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "end"]))]

    def bands(texts):
        found = [(h, p) for _, p, h, _ in neardup.bags(texts)]
        nodes = np.concatenate([links.digests(h, p) for h, p in found] or [np.zeros(0, np.uint64)])
        return nodes, np.stack([np.full(len(nodes), 7, np.uint64), vectors.mix(nodes)], axis=1)

    def features(texts):
        return [(h[a:b], np.ones(b - a), float(b - a)) for _, p, h, _ in neardup.bags(texts) for a, b in zip(p[:-1], p[1:], strict=True)]

    monkeypatch.setattr(links, "INSIDE", 200)
    got = {r["doc_id"]: r["class_id"] for r in links.classes(frame(spark, docs), bands, features, neardup.alike, neardup.shortlist).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_shortlist_has_all_that_are_alike():
    rng = np.random.default_rng(4)
    bags = []
    for _ in range(60):
        h = np.sort(rng.choice(60, rng.integers(45, 60), replace=False)).astype(np.uint64)
        w = 1 + neardup.DAMP * np.log(rng.integers(1, 4, len(h)))
        bags.append((h, w, float(w.sum())))
    found = {tuple(p) for p in neardup.shortlist(bags[:30], bags[30:], 0.8)}
    alike = {(i, j) for i in range(30) for j in range(30) if neardup.alike(bags[i], bags[30 + j], 0.8)}
    assert alike and alike <= found


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_at_plain_similarity_on_frequent_passages(similarity):
    """Common shingles at idf 1, own ones at 1 + LIFT: candidates by the plain similarity."""
    rng, lost, pairs = np.random.default_rng(9), 0, 1000
    common = round(300 * similarity)
    own = (300 - common) // 2
    for _ in range(pairs):
        h = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        w = np.where(np.arange(len(h)) < common, 1.0, 1 + neardup.LIFT)
        of = [np.flatnonzero((np.arange(len(h)) < common + own) if side else (np.arange(len(h)) < common) | (np.arange(len(h)) >= common + own)) for side in (0, 1)]
        a, b = (links.band(neardup.samples(h[x], w[x], np.array([0, len(x)])), neardup.BANDS)[0] for x in of)
        lost += not (a == b).any()
    assert lost <= 1


def test_scores_use_all_training_counts(spark, monkeypatch):
    """With given weights, scores are those of the counts of all texts outside fold 2."""
    given = np.tile([0.6, 0.3, 0.1], (ngrams.CONTEXTS, 1))
    monkeypatch.setattr(ngrams, "expectation_maximisation", lambda *_: given)
    rnd = random.Random(2)
    docs = [(i, " ".join(f"w{rnd.randint(0, 30)}" for _ in range(12))) for i in range(150)]
    tokens = {i: [None, *plain.TOKEN.findall(t), "END"] for i, t in docs}
    train = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs, context, word = (Counter(x for w in train for x in found(w)) for found in (lambda w: zip(w, w[1:]), lambda w: w[:-1], lambda w: w[1:]))
    n, v = sum(word.values()), len(word)
    want = {i: sum(log10(0.6 * pairs[a, b] / max(context[a], 1) + 0.3 * word[b] / n + 0.1 / (v + 1)) for a, b in zip(w, w[1:])) for i, w in tokens.items()}
    got = {r["doc_id"]: r["score"] for r in ngrams.scores(frame(spark, docs).coalesce(2), parts=2).collect()}
    assert got == pytest.approx(want)


def test_document_frequencies_in_small_partitions(spark):
    docs = [(i, f"own{i}" if i % 200 else "a passage that many have") for i in range(1600)]
    got = neardup.idf(frame(spark, docs).repartition(8))
    (_, _, hashes, _), = neardup.bags(pa.array(["a passage that many have"]))
    assert (got(hashes) < 1 + neardup.LIFT).all()


def test_document_frequencies_of_late_shingles(monkeypatch):
    """What is held back is at most n / RARE, however late a shingle comes."""
    monkeypatch.setattr(neardup, "HELD", 500)
    late = "a passage that comes late"
    batches = [pa.RecordBatch.from_arrays([pa.array([f"own{i} {j}" for j in range(50)] + [late] * (i >= 40 and i % 2))], ["text"]) for i in range(100)]
    n = sum(b.num_rows for b in batches)
    (found,) = neardup.frequencies(iter(batches))
    (_, _, hashes, _), = neardup.bags(pa.array([late]))
    df = dict(zip(found.column(0).to_numpy().view(np.uint64).tolist(), found.column(1).to_pylist()))
    assert 30 - n / (4 * neardup.RARE) <= df[int(hashes[0])] <= 30


def test_document_frequencies_sent_by_small_splits(spark, tmp_path, monkeypatch):
    """A table in many small splits sends its frequent shingles, not all of them."""
    passage = "a passage that many have"
    docs = [(i, " ".join(f"own{i}x{j}" for j in range(40)) if i % 50 else passage) for i in range(8000)]
    frame(spark, docs).repartition(100).write.parquet(str(tmp_path / "docs"))
    sent = []
    monkeypatch.setattr(neardup, "materialize", lambda df, name: sent.append(df.count()) or materialize(df, name))
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        table = spark.read.parquet(str(tmp_path / "docs"))
        assert table.rdd.getNumPartitions() == 100
        got = neardup.idf(table)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)
    (_, _, hashes, _), = neardup.bags(pa.array([passage]))
    assert got(hashes) == pytest.approx(1 + neardup.LIFT * np.log(50) / np.log(neardup.RARE))
    assert sent[0] < 100


def test_a_worker_lets_go_of_what_another_operator_kept():
    """Workers are used again by later stages, in whose memory the codec would count."""
    held = weakref.ref(bpe.codec(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN))
    assert held() is bpe.codec(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    list(neardup.frequencies(iter([])))
    assert held() is None
