"""Each operator against a plain version, on edge cases and on a small table."""

import json
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import plain

tokenizers = pytest.importorskip("public_tokenizers")
from sluice.llm import bpe, chat, decontaminate, fingerprint, lines, neardup, ngrams, sharding, toxicity, trees, unigram, vectors  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
rnd = random.Random(7)
PROSE = " ".join(f"word{rnd.randint(0, 400)}" for _ in range(120))
EDGES = [
    (1, None), (2, ""), (3, PROSE), (4, PROSE), (4, PROSE), (5, PROSE.upper().replace("WORD7 ", "other ")), (6, "short"), (7, "  \n\t\n"), (8, "Éa 中文 😀 'll 12 x\x00y" * 30),
    (9, "a" * 3000), (10, PROSE + "\n" + "An Even Longer Line that several of the documents share.\n"), (-5, "negative key"), (None, "a null key"), (11, " ".join(PROSE.split()[:60] * 40)),
]


def frame(spark, docs):
    """Extra columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id bigint, text string, words string, id int, node int")


def small(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' ORDER BY 1").fetchall()


def documents():
    return [(r[0], r[1]) for r in small("documents")]


@pytest.fixture(params=["edges", "table", "none"])
def docs(request):
    return {"edges": EDGES, "table": documents(), "none": []}[request.param]


def by_key(rows):
    return sorted(rows, key=repr)


def test_vectors():
    texts = [t for _, t in EDGES] + ["b c", "a b"]
    data, offsets = vectors.raw(pa.array(texts, pa.string()))
    hashes, upto = vectors.word_hashes(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        own = plain.words(t)
        assert upto[i + 1] - upto[i] == len(own)
        for w, h in zip(own, hashes[upto[i] : upto[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    found, places = vectors.shingles(hashes, upto)
    for i, t in enumerate(texts):
        assert len(set(found[places[i] : places[i + 1]].tolist())) == len(plain.shingles(t))


def test_token_counts(spark, docs):
    got = by_key(tuple(r) for r in unigram.token_counts(frame(spark, docs), PATH, PATTERN).collect())
    scores, split = unigram.zipf_scores(bpe.read_ranks(PATH)), bpe.regex.compile(PATTERN).findall
    want = []
    for i, t in docs:
        found = [plain.unigram(w.encode(), scores) for w in split(t or "") if len(w) < 500]
        if len(found) == len(split(t or "")):
            want.append((i, len(found), sum(n for n, _ in found), round(sum(s for _, s in found), 6)))
    assert len(got) == len(docs)
    assert set(want) <= {(*r[:3], round(r[3], 6) + 0.0) for r in got}


def test_near_duplicates(spark, docs):
    if docs is not EDGES and docs:
        docs = [*docs, *[(i, t) for i, t in docs[:40]], *[(i, "another text of this key " + t) for i, t in docs[40:45]], (None, docs[50][1]), (None, PROSE)]
    got = neardup.near_duplicates(frame(spark, docs)).collect()
    want = plain.weighted_classes(docs, neardup.LIFT, neardup.DAMP)
    copies = {}
    for i, t in docs:
        of = repr(sorted(plain.Counter(zip(*(plain.words(t)[k:] for k in range(5)))).items()) or plain.words(t))
        copies[of] = min(copies.get(of, (True, 0)), (i is None, i or 0))
    firsts = [copies[repr(sorted(plain.Counter(zip(*(plain.words(t)[k:] for k in range(5)))).items()) or plain.words(t))] for _, t in docs]
    assert by_key((r["doc_id"], r["class_id"], r["copy_of"]) for r in got) == by_key((i, c, None if f[0] else f[1]) for (i, _), (c, _), f in zip(docs, want, firsts, strict=True))
    assert len({r["class_node"] for r in got}) == len({n for _, n in want})


def test_dedup_keeps_one_row_of_each_class(spark):
    docs = [*EDGES, (20, "two texts of one key, the first of them"), (20, "and the other one, which is like nothing else"), (21, "and the other one, which is like nothing else"), (None, "another null key")]
    kept = neardup.dedup(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    least = {}
    for (i, _), (_, n) in zip(docs, plain.weighted_classes(docs, neardup.LIFT, neardup.DAMP), strict=True):
        least[n] = min(least.get(n, (True, 0)), (i is None, i or 0))
    assert by_key(r["doc_id"] for r in kept.collect()) == by_key(None if nil else i for nil, i in least.values())


def test_near_duplicates_of_a_large_group(spark):
    """Against all pairs: variants of one text, some alike and some not, texts with a common
    passage, and texts repeated within themselves."""
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.choice((1, 2, 3, 5))):
            w[rnd.randrange(200)] = f"edit{rnd.randint(0, 10**9)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"v{rnd.randint(0, 5000)}" for _ in range(50)) + " a common passage that all of these documents have at their very end") for i in range(200)]
    for i, times in enumerate((2, 3, 10) * 10):
        own = " ".join(f"u{rnd.randint(0, 10**9)}" for _ in range(200))
        docs += [(2000 + 2 * i, own), (2001 + 2 * i, " ".join([own] * times))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    want = {i: c for (i, _), (c, _) in zip(docs, plain.weighted_classes(docs, neardup.LIFT, neardup.DAMP), strict=True)}
    together = lambda found: {(i, j) for i, a in found.items() for j, b in found.items() if i < j and a == b}
    pairs, all_pairs = together(got), together(want)
    assert pairs <= all_pairs and len(pairs) >= 0.99 * len(all_pairs) > 20_000
    assert all(got[2001 + 2 * i] == 2000 + 2 * i for i in range(30))


def test_weighted_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    errors = []
    for _ in range(20):
        a, b = (np.where(rng.random(4000) < 0.7, rng.choice([1.0, 2.0, 3.0], 4000), 0) for _ in range(2))
        sampled = [neardup.samples(hashes[w > 0], w[w > 0], np.array([0, (w > 0).sum()]))[0] for w in (a, b)]
        errors.append((sampled[0] == sampled[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.05


def test_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = by_key(tuple(r) for r in bpe.encode(frame(spark, docs), PATH, PATTERN).collect())
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), ids, plain.sha(",".join(map(str, ids))), plain.sha(t or "")))
    assert got == by_key(want)


def test_bpe_states_bound_changes_nothing(monkeypatch):
    texts = [t for _, t in documents()[:20]]
    whole = bpe.Codec(PATH, PATTERN)
    for name, value in (("MAX_STATES", 50), ("MAX_WORDS", 5), ("MAX_FITS", 5), ("RENEW", 3)):
        monkeypatch.setattr(bpe, name, value)
    bounded = bpe.Codec(PATH, PATTERN)
    texts += ["ab" * 3000 + "a" * 3000, "中文" * 2000, "q" * 999]
    assert [whole.encode(t) for t in texts] == [bounded.encode(t) for t in texts]
    assert len(bounded.transducer.states) <= 50


def test_bpe_equals_its_definition(monkeypatch):
    """Small vocabularies of random merges, with and without kept states."""
    draw = random.Random(3)
    for states in (2, 30_000):
        monkeypatch.setattr(bpe, "MAX_STATES", states)
        monkeypatch.setattr(bpe, "SOON", 3 if states == 2 else 64)
        for _ in range(30):
            ranks = {bytes((b,)): b for b in b"abc"}
            for rank in range(200, 240):
                ranks.setdefault(draw.choice(list(ranks)) + draw.choice(list(ranks)), rank)
            coder = bpe.Transducer(ranks)
            for _ in range(40):
                data = bytes(draw.choices(b"abc", k=draw.randint(0, 60)))
                assert coder.encode(data) == [ranks[t] for t in coder.merges.merge(data)]


def test_bpe_what_fits_is_held_for_the_data_at_hand(monkeypatch):
    """When the bound is met, pairs of tokens met since are held and not judged each time anew."""
    monkeypatch.setattr(bpe, "MAX_FITS", 200)
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    coder = bpe.Codec(PATH, PATTERN).transducer
    for i in range(300):
        coder.encode(b"earlier" + bytes(97 + i * p % 26 for p in (3, 5, 7, 11, 17)))
    judged, fit = [], coder.merges._fit
    monkeypatch.setattr(coder.merges, "_fit", lambda a, b: judged.append((a, b)) or fit(a, b))
    for _ in range(50):
        coder.encode(b" anwordthatislatelyfrequent")
    assert len(judged) <= 2 * len(set(judged))


def test_utf8_stream():
    text = "aé中😀" * 9
    for size in (1, 2, 3, 5):
        s, data = bpe.Utf8Stream(), text.encode()
        assert "".join([*(s.feed(data[i : i + size]) for i in range(0, len(data), size)), s.close()]) == text
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe4\xb8") + s.close() == "�"


def test_decontamination(spark, docs, monkeypatch):
    items = [(r[0], r[1]) for r in small("benchmark")] + [(900, "short"), (901, " ".join(PROSE.split()[20:50])), (902, None), (903, "..."), (None, " ".join(PROSE.split()[3:10])), (904, "12 X")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, ws int")
    got = decontaminate.contamination(frame(spark, docs), bench).collect()
    assert by_key((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == by_key(plain.contamination(docs, items))
    kept = decontaminate.clean(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns
    assert by_key((r["doc_id"], r["text"]) for r in kept.collect()) == by_key((i, t) for (i, t), c in zip(docs, plain.contamination(docs, items), strict=True) if not c[4])
    assert not [r for r in decontaminate.contamination(frame(spark, docs), bench.limit(0)).collect() if r["n_hit"]]
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)  # by shuffle
    dealt = decontaminate.contamination(frame(spark, docs), bench).collect()
    assert by_key((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in dealt) == by_key(plain.contamination(docs, items))


def test_sharding(spark, docs):
    got = sharding.shard(frame(spark, docs), 40, rows_per_group=3).collect()
    assert by_key((r["doc_id"], r["size"], r["shard"], r["grown_shard"]) for r in got) == by_key((i, len((t or "").encode()) + 16, plain.jump(i or 0, 40), plain.jump(i or 0, 41)) for i, t in docs)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_toxicity(spark, docs):
    rnd = random.Random(5)
    labelled = [(i, " ".join([f"w{rnd.randint(0, 60)}" for _ in range(40)] + ["Nastyword YOU!!"] * (i % 4 == 0))) for i in range(2000, 2600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i, _ in labelled] + [(None, 1, 0), (2000, None, 0)], "doc_id bigint, toxic int, y int")
    model = toxicity.learn(frame(spark, labelled), labels)
    got = toxicity.scores(frame(spark, labelled + docs), model).collect()
    assert len(got) == len(labelled) + len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["held_out"] and (r["doc_id"] or 0) >= 2000)
    kept = toxicity.clean(frame(spark, labelled), model)
    assert kept.columns == frame(spark, []).columns and all(r["doc_id"] % 4 for r in kept.collect())
    none = toxicity.learn(frame(spark, docs), labels.limit(0))
    assert all(r["score"] == 0 for r in toxicity.scores(frame(spark, docs), none).collect())


@pytest.mark.parametrize("text", ["a" * 1_000_000, "!" * 1_000_000, "1" * 500_000 + "!" * 500_000, "bad you " * 100_000], ids=["letters", "marks", "digits", "hits"])
def test_features_of_long_texts_are_linear(text):
    began = time.process_time()
    (row,) = toxicity.features([text], {"bad": 2.0})
    assert time.process_time() - began < 4 and np.isfinite(row).all()


def test_masked_words_are_those_of_the_plain_pattern():
    plainly, rnd = re.compile(r"\w*[@$*!0-9|+.\-_]+\w[\w@$*!|+.\-]*"), random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab1_!@-. é9*|") for _ in range(rnd.randint(1, 14)))
        assert plainly.findall(text) == toxicity._MASKED.findall(text)


def test_trees_and_steps():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    margin = trees.Boosted().fit(x[:1000], y[:1000]).margin(x[1000:])
    assert ((margin > 0) == y[1000:]).mean() > 0.95
    steps = trees.Isotonic().fit(margin, y[1000:])
    assert (np.diff(steps(np.sort(margin))) >= 0).all()


def test_chat(spark):
    call = lambda i, name, args: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"
    rows = [
        (1, 0, "user", "hi \"there\"\n"), (1, 1, "assistant", "let me see " + call("c1", "add", {"b": 2, "a": 1}) + call("c2", "add", {"a": "x"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "d1", "content": "early"})), (2, 1, "assistant", call("d1", "none", {}) + "<tool_call>junk</tool_call>"),
        (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    messages = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, calls int, errors string")
    tools = spark.createDataFrame([("add", json.dumps({"required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}))], "name string, parameters string")
    got = {r["conv_id"]: r for r in chat.format_chats(messages, tools).collect()}
    first = json.loads(got[1]["chat"])["messages"]
    assert first[1] == {"content": "let me see", "role": "assistant", "tool_calls": [{"arguments": {"a": 1, "b": 2}, "id": "c1", "name": "add"}, {"arguments": {"a": "x"}, "id": "c2", "name": "add"}]}
    assert got[1]["chat"] == json.dumps(json.loads(got[1]["chat"]), sort_keys=True, separators=(",", ":"))
    assert got[1]["errors"] == ["c2:missing:b", "c2:type:a", "unanswered:c2", "unlinked:zz"] and (got[1]["n_calls"], got[1]["n_results"], got[1]["n_linked"]) == (2, 2, 1)
    assert [m["role"] for m in json.loads(got[2]["chat"])["messages"]] == ["assistant", "tool"]
    assert got[2]["errors"] == ["?:unreadable", "d1:unknown_tool"]
    assert got[3]["chat"] == '{"messages":[{"content":null,"role":null}]}' and got[None]["n_turns"] == 1 and got[4]["n_turns"] == 2
    assert chat.format_chats(messages.limit(0)).count() == 0


def test_random_chats(spark):
    """Ties, early and repeated results, repeated identifiers, declared tools: against plain sorting by Kahn's method."""
    rnd, rows = random.Random(11), []
    schema = {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}
    for conv in [None, *range(99)]:
        if rnd.random() < 0.6:
            rows.append((conv, 0, "system", "You have <tools>" + json.dumps([{"name": "add", "parameters": schema}, {"name": "say"}]) + "</tools> now"))
        for _ in range(rnd.randint(0, 9)):
            i, turn = f"c{rnd.randint(0, 5)}", rnd.randint(0, 4)
            call = lambda: "<tool_call>" + rnd.choice([json.dumps({"id": rnd.choice([i, f"c{rnd.randint(0, 5)}"]), "name": rnd.choice(["add", "say", "other"]), "arguments": rnd.choice([{"a": 1}, {"b": "x"}, {"a": "1", "b": 2}, {}])}), "{junk"]) + "</tool_call>"
            rows.append(rnd.choice([
                (conv, turn, "assistant", "".join(call() for _ in range(rnd.randint(0, 3))) + f"say {rnd.randint(0, 2)}"), (conv, turn, "tool", json.dumps({"tool_call_id": i, "content": f"r{rnd.randint(0, 3)}"})),
                (conv, turn, "user", "hi"), (conv, turn, None, None),
            ]))
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    want = plain.chats(rows)
    assert {c: (r["n_turns"], r["n_calls"], r["n_results"], r["n_linked"], r["errors"], json.loads(r["chat"])["messages"]) for c, r in got.items()} == want
    errors = " ".join(e for w in want.values() for e in w[4])
    assert sum(w[3] for w in want.values()) > 20 and all(e in errors for e in ("unreadable", "unknown_tool", "missing:a", "type:a", "duplicate:", "unlinked:", "unanswered:"))
    assert all(r["chat"] == json.dumps(json.loads(r["chat"]), sort_keys=True, separators=(",", ":")) for r in got.values())


def test_line_dedup(spark, docs):
    shared = "A line that is long enough to be counted, %d times"
    more = docs + [(5000 + i, "\n".join([shared % 1, f"own {i}", "\t" + (shared % 1).upper() + " ", shared % 2 if i < 4 else "", "x" * 39])) for i in range(6)] + [(5007, shared % 3), (5007, shared % 3), (5003, f"another text\n{shared % 1}\nof a key"), (5005, f"{shared % 1}\nand one of the largest key")]
    got = lines.dedup_lines(frame(spark, more)).collect()
    assert by_key((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == by_key(plain.kept_lines(more))


def test_lm_scores(spark, docs):
    got = ngrams.scores(frame(spark, docs).coalesce(2), parts=2).collect()
    want = plain.base_scores(docs)
    assert by_key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == by_key((*w[:5], round(w[5], 6)) for w in want)
    assert all(r["score"] < 0 for r in got)
    if len(docs) > 100:
        scores = plain.interpolated(docs, ngrams.CONTEXTS)
        assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(dict(scores), rel=5e-3)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_fingerprints(spark, docs):
    got = fingerprint.fingerprints(frame(spark, docs)).collect()
    key = lambda d: (d[0] is None, -(d[0] or 0))
    order = sorted(docs, key=key)
    if any(order[i][0] == order[i - 1][0] and order[i][1] != order[i - 1][1] for i in range(1, len(order))):
        pytest.fail("ties of unequal texts are not in these cases")
    want = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want.append((k, len(t), plain.sha(t[: len(t) - len(t) // 3] + after[: len(t) // 3])))
    assert by_key((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == by_key(want)
    keyed = [d for d in docs if d[0] is not None]
    assert by_key((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == by_key((i, c) for (i, _), c in zip(keyed, plain.classes(keyed), strict=True))
    texts, marks = dict(docs), {}
    for r in got:
        assert marks.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    errors = []
    for r, (k, t) in zip(sorted(got, key=lambda r: key((r["doc_id"],))), order, strict=True):
        i = order.index((k, t))
        if order.count((k, t)) == 1:
            errors.append(r["near_next"] - plain.jaccard(plain.shingles(t), plain.shingles(order[(i + 1) % len(order)][1])))
    assert not errors or max(map(abs, errors)) < 0.25


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprints_of_null_and_repeated_keys(spark, parts):
    """Any number of ranges; null keys and one repeated key are split by their texts."""
    docs = [(None, f"text {i} of no key") for i in range(30)] + [(7, f"text {i} of one key " * (i % 5)) for i in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.fingerprints(frame(spark, docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert by_key((r["doc_id"], r["n_chars"]) for r in got) == by_key((i, len(t)) for i, t in docs)
