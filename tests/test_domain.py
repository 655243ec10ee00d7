import pytest

from sluice.domain import assistant, attack, indicators, vocabulary
from sluice.errors import QueryError
from sluice.plans.nodes import Aggregate
from sluice.sources.sinks import Store
from sluice.streaming import ingest


def test_attack(spark):
    assert [attack.normalize_technique(t) for t in ("T1059", "t1059.001", "TA0001", "", None, "T105")] == ["T1059", "T1059", None, None, None, None]
    assert attack.tactic_for_technique("t1059.001") == "execution"
    assert attack.tactic_for_technique("T9999") is None
    assert all(attack.tactic_for_technique(t) == tactic for t, tactic in attack.CATALOG) and len({t for t, _ in attack.CATALOG}) == len(attack.CATALOG)
    df = spark.createDataFrame([("T1003.1",), ("x",), (None,)], "t string")
    assert [r["tactic"] for r in attack.with_tactic(df, "t").orderBy("t").collect()] == [None, "credential-access", None]
    assert len(vocabulary.CATEGORIES) == len(set(vocabulary.CATEGORIES)) == 40
    assert vocabulary.category_ok("dns") and not vocabulary.category_ok("DNS") and vocabulary.framework_ok("cis")


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("[ipv6-addr:value='fe80::9']", [("ip", "fe80::9")]),
        ("  ( ( [email-addr:value = 'who@mail.test'] ) ) ", [("email", "who@mail.test")]),
        ("[((domain-name:value = 'q[1].test'))]", [("domain", "q[1].test")]),
        ("[file:hashes.'MD5' = '01' OR file:hashes.SHA-1='02'\tOR\nfile:hashes.\"sha256\" = '03']", [("hash_md5", "01"), ("hash_sha1", "02"), ("hash_sha256", "03")]),
        (r"[url:value='say \'[a] OR b\' AND c = d']", [("url", "say '[a] OR b' AND c = d")]),
        (r"[url:value = 'back\\slash']", [("url", "back\\slash")]),
        ("[url:value = '']", [("url", "")]),
        ("[process:pid = '12']", "under the path process:pid"),
        ("[file:hashes.BLAKE3 = '00']", "not one of MD5"),
        ("[file:hashes.SHA 1 = '00']", "not one of MD5"),
        ("[email-addr:value = \"a@b\"]", "single quotes"),
        ("[email-addr:value = 'a' 'b']", "single quotes"),
        ("[email-addr:value = 12]", "single quotes"),
        ("[domain-name:value MATCHES '^x']", "MATCHES is not translated"),
        ("[ipv4-addr:value ISSUBSET '10.0.0.0/8']", "ISSUBSET is not translated"),
        ("[file:size > '9']", "> is not translated"),
        ("[ipv4-addr:value = '9.9.9.9' AND file:hashes.MD5 = '04']", "AND is not translated"),
        ("[url:value = 'a'] REPEATS 2 TIMES", "REPEATS is not translated"),
        ("[url:value = 'a'] OR [url:value = 'b']", "beside the one observation"),
        ("seen: [url:value = 'a']", "beside the one observation"),
        ("[url:value = 'a' OR [url:value = 'b']]", "nested"),
        ("[url:value = 'a", "quote is left open"),
        ("[url:value = 'a'", "never closed"),
        ("[ OR ]", "compares nothing"),
        (" \n", "no pattern"),
        ("email-addr:value", "an observation in"),
        ("[email-addr:value]", "an equality is expected"),
    ],
)
def test_patterns(pattern, want):
    if isinstance(want, list):
        assert indicators.parse_pattern(pattern) == want
    else:
        with pytest.raises(indicators.PatternError, match=want):
            indicators.parse_pattern(pattern)


def test_indicators(spark):
    cases = [
        ("ip", " 2A00::1 ", "2a00::1"), ("ip", "abc", None), ("domain", "*.Evil.example..", "evil.example"), ("domain", "x", None), ("url", "HTTP://A", "http://a"), ("email", "A@b", "a@b"),
        ("hash_md5", "A" * 32, "a" * 32), ("hash_sha1", "a", None), ("url", "\u00a0HTTP://ÉX\t\n", "http://Éx"), ("domain", "\tÉvil.example", None), ("email", "É@", "É@"), ("email", "a@", None),
        ("ip", "1.2.3.4\n", "1.2.3.4"), ("hash_md5", "\x0b" + "B" * 32 + "\u3000", "b" * 32), ("url", " \n ", None), ("ip", "..", ".."),
    ]
    for kind, raw, want in cases:
        assert indicators.normalize_ioc(kind, raw) == want, raw
        df = spark.createDataFrame([(raw,)], "v string")
        assert df.select(indicators.normalized(kind, df.v)).first()[0] == want, raw
    ids = ["T1059", "\tt1059.001 ", "T1059.01", "T12", " t1003 .x", "TA0001", "T1059\n", "x", "", "\u2003T1486.002\u00a0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "i int, t string")
    got = [tuple(r) for r in attack.with_tactic(df, "t").select("i", attack.normalized(df.t), attack.parent(df.t), "tactic").sort("i").collect()]
    assert got == [(i, attack.normalize_technique(t), attack.parent_technique(t), attack.tactic_for_technique(t)) for i, t in enumerate(ids)]
    bundle = {"type": "bundle", "objects": [
        {"type": "indicator", "id": "i1", "pattern": "[domain-name:value='*.bad.example' OR ipv4-addr:value='junk']", "confidence": 7, "labels": ["x", 1]},
        {"type": "indicator", "id": "i2", "pattern_type": "yara", "pattern": "x"}, {"type": "indicator", "id": "i3"}, {"type": "malware"},
    ]}
    got = indicators.import_bundle(bundle)
    assert got.iocs == [indicators.Ioc("domain", "bad.example", "i1", 7, None, ("x",))] and [i for i, _ in got.skipped] == ["i1", "i2", "i3"]
    seen = spark.createDataFrame([(1, "BAD.example."), (2, "good.example"), (3, None)], "id int, host string")
    assert [r["id"] for r in indicators.match(seen, got.frame(spark), {"host": "domain"}).collect()] == [1]


def test_assistant():
    class Says:
        def __init__(self, *texts):
            self.texts = list(texts)

        def complete(self, system, user, max_tokens):
            assert "api_token" not in user
            return assistant.Answer(self.texts.pop(0), 2, 1)

    def check(q):
        if "DROP" in q:
            raise QueryError("no")

    ok = assistant.ask(Says("```spl\nsearch a=1\n```"), "q", ["a", "api_token"], ["web"], check)
    assert (ok.query, ok.valid, ok.retried) == ("search a=1", True, False)
    again = assistant.ask(Says("DROP TABLE x", "R: search | head 1"), "q", ["a"], [], check)
    assert (again.query, again.valid, again.retried, again.prompt_tokens) == ("search | head 1", True, True, 4)
    assert not assistant.ask(Says("DROP", "DROP"), "q", [], [], check).valid


def test_sinks_and_streams(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = spark.createDataFrame([(10, "a"), (70, "a"), (100_000, "b")], "ts bigint, host string")
    store.insert_events(rows)
    store.insert_metrics(spark.createDataFrame([(1, "up", 2.0)], "ts bigint, name string, value double"))
    store.insert_snapshots(spark.createDataFrame([(1, "k")], "ts bigint, kind string"))
    assert {r["env_id"] for r in store.read(spark, "event").collect()} == {"prod"}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts bigint, host string").parquet(str(tmp_path / "in"))
    ingest.ingest_events(stream, store, str(tmp_path / "c1"), once=True).awaitTermination(60)
    assert store.read(spark, "event").count() == 6
    store.insert_events(rows, "batch-7")
    store.insert_events(rows, "batch-7")  # a replay replaces what the batch wrote
    assert store.read(spark, "event").count() == 9
    assert store.read(spark, "event", 86_400, 172_800).count() == 3

    def seen(df, name, mode="complete"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert seen(ingest.timechart(stream, 60, ("host",)), "chart") == [(0, "a", 1), (60, "a", 1), (99_960, "b", 1)]
    assert seen(ingest.timechart(stream, 86_400, (), measure=Aggregate("sum", "ts")), "sums") == [(0, 80), (86_400, 100_000)]
    assert seen(ingest.timechart(stream, 86_400, (), measure=Aggregate("max", "host")), "most") == [(0, "a"), (86_400, "b")]
    assert seen(ingest.dedup(stream, ("host",)).select("host"), "firsts", "append") == [("a",), ("b",)]
    with pytest.raises(QueryError, match="on a stream"):
        ingest.timechart(stream, 60, measure=Aggregate("list", "host"))
