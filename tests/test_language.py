"""Parsing, refusals and semantics on hand-made frames."""

import random
import threading
import time

import pytest

import __spark_entry__
from sluice.engine import COMPLETIONS, Engine
from sluice.errors import ConfigError, QueryError
from sluice.plans.limits import Limits
from sluice.plans.nodes import Compare, Free, Member
from sluice.plans.parser import automatic_span, filter_terms
from sluice.plans.queries import run
from sluice.sources.catalog import Catalog
from sluice.sources.schema import Knowledge, engagements, events
from sluice.sources.sinks import EVENT, METRIC, Store, conform

ROWS = [
    # ts, host, category, severity, src_ip, message, fields, id, env
    (100, "a", "auth", 3, "10.0.0.1", "failed login", '{"user":"Bob","dport":80,"tags":["x","y",null],"pan":"1234567890"}', 1, "prod"),
    (200, "a", "auth", 1, "10.0.0.2", "ok 100%", '{"user":"bob","dport":443,"o":{"p":1,"q":"z"}}', 2, "prod"),
    (300, "b", "web", None, None, None, '{"dport":"x","flag":true,"tags":[]}', 3, "dev"),
    (-90, None, "web", 5, "10.0.0.1", "it's \\ a_b", "not json", 4, None),
    (400, "b", None, 2, "10.0.0.3", "Failed", None, 5, "prod"),
]


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(ROWS, "ts bigint, host string, category string, severity bigint, src_ip string, message string, fields string, id bigint, env_id string")
    kv = spark.createDataFrame([("owners", "a", '{"team":"red"}'), ("owners", "b", "broken"), ("other", "a", "{}")], "name string, key string, val string")
    m = [(1, "h", "up", '{"job":"api"}', 5.0), (2, "h", "up", '{"job":"api"}', 9.0), (3, "h", "up", '{"job":"api"}', 4.0), (3, "h", "up", '{"job":"db"}', 1.0)]
    metric = conform(spark.createDataFrame(m, METRIC), METRIC)
    rollup = spark.createDataFrame([(0, "h", "up", '{"job":"api"}', 2.0)], "ts bigint, host string, name string, labels string, avg double")
    catalog = Catalog({"event": conform(df, EVENT).drop("env_id").join(df.select("id", "env_id"), "id"), "lookup_kv": kv, "metric": metric, "metric_rollup": rollup})
    return Engine(catalog, events())


def rows(engine, text, *columns, schema=None):
    df = Engine(engine.catalog, schema or engine.schema).query(text)
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def ids(engine, text, **more):
    df = Engine(engine.catalog, more.get("schema", engine.schema).with_cursor_id()).query(text)
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("host=a", [1, 2]),
        ("search host:a severity>=2", [1]),
        ("severity != 1", [1, 4, 5]),
        ("src_ip=10.0.0.*", [1, 2, 4, 5]),
        ("src_ip!=*.1", [2, 5]),
        ("host=~^[ab]$ category=auth", [1, 2]),
        ("dport>=80", [1, 2]),
        ('dport="80"', [1]),
        ("user in (BOB)", [1, 2]),
        ("user not in (Bob)", [2]),
        ("severity in (1, 5)", [2, 4]),
        ("host in ()", []),
        ("failed", [1, 5]),
        ('"failed login"', [1]),
        ("100%", [2]),
        ("\\ a", [4]),
        ("host = b", [3, 5]),
        ("*", [1, 2, 3, 4, 5]),
        ("flag=true", [3]),
        ("| host=a", [1, 2]),
        ('message="user in (a,b)"', []),
    ],
)
def test_filters(engine, text, want):
    assert ids(engine, text) == want


def test_filter_terms():
    assert filter_terms('a=1 b:x* "c d" e in (1,"",x)') == (Member("e", False, ("1", "", "x")), Compare("a", "=", "1", "num"), Compare("b", "=", "x*", "glob"), Free("c d"))
    assert filter_terms("(foo in (1,2))") == (Member("foo", False, ("1", "2")), Free("("), Free(")"))
    assert filter_terms("10:00:00 /x/y?a=1") == (Compare("10", "=", "00:00", "text"), Free("/x/y?a=1"))
    assert filter_terms('"user-agent=curl/7"') == (Free("user-agent=curl/7"),)


@pytest.mark.parametrize("text", ["x-forwarded-for=1", "http.status = 200", 'foo-bar="x"', 'foo-bar" = 1', "cache/status in (1)", "user@host in (a)"])
def test_bad_field_names_are_refused(text):
    with pytest.raises(QueryError, match="invalid field"):
        filter_terms(text)


@pytest.mark.parametrize(
    "text, message",
    [
        ("search | nope", "unknown stage"),
        ("search | head -1", "negative"),
        ("search | top -5 host", "negative"),
        ("search | stats median(x)", "not supported"),
        ("search | stats count by a,,b", "invalid field"),
        ("search | stats count by host | stats count by user", "unknown field in by"),
        ("search | stats count | stats count by day", "timechart"),
        ("search | timechart every=5 count", "unknown option"),
        ("search | timechart span=0s count", "invalid span"),
        ("search | rename a b", "a AS b"),
        ("search | where 1 2", "expected"),
        ("search | join host [search | stats count]", "right"),
        ("search | append search", "subsearch"),
        ("search | append [search | append [search | append [search | append [search]]]]", "deep"),
        ("search | eval x = sleep(1)", "function not allowed"),
        ("search | eval x = select", "not allowed"),
        ("search | eval x = 'a", "unterminated"),
        ("search | eval x = 1; 2", "character"),
        ("search | eval x = lower()", "takes 1"),
        ("search | lookup owners host OUTPUT", "at least one"),
        ("search | stats count | eval y = zz", "unknown field"),
        ("search | rate", "ts and value"),
        ('search | rex message "(x)"', "named group"),
        ("metric", "name is expected"),
        ("metric up junk", "not supported"),
        ("metric up job-x=1", "invalid label"),
    ],
)
def test_refusals(engine, text, message):
    with pytest.raises(QueryError, match=message):
        engine.query(text)


def test_stages(engine):
    assert rows(engine, "search | stats count by host") == [("a", 2), ("b", 2), (None, 1)]
    assert rows(engine, "search | stats max(dport)") == [("x",)]
    assert rows(engine, "search host=a | stats min(dport)") == [("80",)]
    assert rows(engine, "search | stats sum(dport)") == [(523.0,)]
    assert rows(engine, "search host=zz | stats values(user)") == [(None,)]
    assert rows(engine, "search | stats list(user)") == [("Bob,bob",)]
    assert rows(engine, "search | timechart span=1h count") == [(0, 5)]
    assert rows(engine, "search | mvexpand tags | table id tags", "tags") == [("x",), ("y",), (None,)]
    assert rows(engine, "search | mvexpand o | table o") == [("1",), ("z",)]
    assert rows(engine, "search | mvexpand dport | table dport") == [("443",), ("80",)]
    assert rows(engine, "search | lookup owners host OUTPUT team | stats count by team") == [("red", 2), (None, 3)]
    assert rows(engine, 'search | rex message "(?P<first_word>[A-Za-z]+)" | stats count by first_word') == [("Failed", 1), ("failed", 1), ("it", 1), ("ok", 1), (None, 1)]
    assert rows(engine, "search | dedup host | stats count") == [(3,)]
    assert rows(engine, "search | eventstats max(severity) by host | table ts,max") == [(-90, 5), (100, 3), (200, 3), (300, 2), (400, 2)]
    assert rows(engine, "search host=a | sort -dport | head 1 | table dport") == [("443",)]
    assert rows(engine, "search | where host in (A) | stats count") == [(0,)]
    assert rows(engine, "metric up job=api by job | rate | table ts,rate") == [(0, None), (1, 3.0), (2, 4.0), (3, None)]
    assert rows(engine, "metric up value>4 | stats count") == [(2,)]
    assert rows(engine, "search host=a | append [search host=b | table host] | stats count by host") == [("a", 2), ("b", 2)]
    assert rows(engine, "search host=a | join host [search | stats count by host] | table host,count") == [("a", 2), ("a", 2)]


@pytest.mark.parametrize(
    "expression, want",
    [
        ("2*3 . 4", 68.0), ("7/2", 3), ("7/0", None), ("7%0", None), ("7.0/2", 3.5), ("-7/2", -3), ("round(2.5)", 3.0), ("round(0-2.5)", -3.0), ("round(1.25,1)", 1.3),
        ("substr('hello',0,3)", "he"), ("substr('hello',-3,2)", "ll"), ("substr('hello',2)", "ello"), ("substr('hello',4,-2)", "el"), ("min(1,null)", None), ("max(2,10)", 10),
        ("if(null,1,2)", 2), ("coalesce(null,'x')", "x"), ("'a' glob 'A'", False), ("'abc' like 'A_C'", True), ("not 1 = 2 and true", True), ("null is null", True), ("trim('xxaxx','x')", "a"),
        ("length('é')", 1), ("3 in (1,2,3)", True), ("'10' > 9", True), ("1 == 1", True), ("nullif(1,1)", None),
    ],
)
def test_eval(engine, expression, want):
    (got,) = {r[0] for r in rows(engine, f"search | eval made = {expression} | table made")}
    assert got == want


def test_row_filter_and_environment(engine):
    assert ids(engine, "search", schema=events().with_row_filter("id", [1, 3])) == [1, 3]
    assert ids(engine, "search | append [search]", schema=events().with_row_filter("id", [1])) == [1, 1]
    assert ids(engine, "search", schema=events().with_row_filter("id", [])) == []
    assert ids(engine, "search", schema=events().with_row_filter("id; drop", [1])) == []
    assert ids(engine, "search", schema=events().with_env("prod")) == [1, 2, 5]
    assert [r["ts"] for r in engine.query("search", 100, 200).collect()] == [100, 200]


HIDE = [
    "search | table fields", "search", "search | rename fields AS copy | table copy", "search | eval copy = fields | table copy", "search | eval copy = FIELDS | table copy",
    "search | append [search]", "search | eval pan = 1", "search | rename host AS pan", "search | lookup owners host OUTPUT pan", 'search | rex host "(?<pan>a)"',
    "search | stats values(fields)", "search | stats count by fields", "search | dedup fields", "search | top fields", "search | join host [search | table host fields]",
    "search | eventstats max(fields) by host", "search | table pan", "search | stats count by pan", "search | mvexpand fields", "search | where pan = 1234567890", "search | sort pan",
]


@pytest.mark.parametrize("text", HIDE)
@pytest.mark.parametrize("mask", ["mask", "hash", "redact", "deny"])
def test_masked_key_never_leaves(engine, text, mask):
    found = Engine(engine.catalog, events().with_masks({"pan": mask}, "salt")).query(text).collect()
    assert "1234567890" not in repr(found)


def test_masks(engine):
    seen = lambda mask, field: {r[0] for r in rows(engine, f"search id=1 | table {field}", schema=events().with_masks({field: mask}, "s"))}
    assert seen("mask", "host") == {"***"}
    assert seen("partial", "pan") == {"***7890"}
    assert seen("redact", "message") == {None}
    for text in ("host=a", "host in (a)", "host=a*", "host=~a"):
        with pytest.raises(QueryError, match="masked"):
            Engine(engine.catalog, events().with_masks({"host": "mask"})).query(text)
    with pytest.raises(QueryError, match="masked"):
        Engine(engine.catalog, events().with_masks({"message": "deny"})).query("failed")


def test_knowledge(engine):
    known = Knowledge(
        aliases={"user_name": "user"}, calculated=(("double", "severity * 2"), ("bad name", "1"), ("worse", "sleep(1)")), eventtypes={"logins": "category=auth eventtype=strong", "strong": "severity>=2", "loop": "eventtype=loop"},
        tags={"edge": (("host", "b"), ("severity", "1"))}, macros={"on": (("h", "s"), "host=$h$ severity>=$s$")}, lookups=(("owners", "host", ("team",)),),
    )
    schema = events().with_knowledge(known)
    assert ids(engine, "eventtype=logins", schema=schema) == [1]
    assert ids(engine, "tag=edge", schema=schema) == [2, 3, 5]
    assert ids(engine, "`on(a, 2)`", schema=schema) == [1]
    assert rows(engine, "search user_name=Bob | table user_name,double,team", schema=schema) == [("Bob", 6, "red")]
    for text, message in (("eventtype=loop", "deep"), ("eventtype=none", "unknown"), ("tag=none", "unknown"), ("`on(a)`", "arguments"), ("`on(a;b,1)`", "not allowed"), ("`off`", "unknown macro")):
        with pytest.raises(QueryError, match=message):
            Engine(engine.catalog, schema).query(text)


def test_join_by_parent_technique(spark):
    runs = spark.createDataFrame([(1, "T1059.001"), (2, "t1003"), (3, None)], "ts bigint, mitre string")
    finding = spark.createDataFrame([(9, "T1059", "x")], "ts bigint, mitre string, title string")
    wide = lambda df, base: df.select(*(df[c] if c in df.columns else df["mitre"].alias(c) for c in (*base.columns, *base.filterable)))
    s = engagements()
    engine = Engine(Catalog({"finding": wide(finding, s.default), "runrecord": wide(runs, s.alternatives[0])}), s)
    got = {(r["ts"], r["title"]) for r in engine.query("runs | table ts,mitre | join mitre [search | table mitre,title]").collect()}
    assert got == {(1, "x"), (2, None), (3, None)}


def test_limits(engine, monkeypatch):
    with pytest.raises(QueryError, match="stages"):
        engine.query("search" + "| head 1" * 70)
    with pytest.raises(QueryError, match="bytes"):
        Engine(engine.catalog, engine.schema, Limits(text_bytes=10)).query("search host=abcdef")
    with pytest.raises(QueryError, match="span"):
        engine.query("search | timechart span=99999d count")
    monkeypatch.setenv("SLUICE_MAX_STAGES", "many")
    with pytest.raises(ConfigError):
        Limits.from_environment()
    engine.query("search src_ip in (" + ",".join(f"10.0.{i // 250}.{i % 250}" for i in range(2000)) + ")")


def test_automatic_span():
    assert automatic_span(0, 0) == 900
    assert automatic_span(1, 3601) == 60
    assert automatic_span(1, 10**9) == 604800


def test_completions_run(engine):
    arguments = {
        "where": "where host = a", "sort": "sort host", "rex": 'rex host "(?<x>a)"', "fields": "fields host", "rename": "rename host AS h", "dedup": "dedup host", "top": "top host", "rare": "rare host",
        "eval": "eval x = 1", "append": "append [search]", "join": "join host [search | stats count by host]", "mvexpand": "mvexpand tags", "lookup": "lookup owners host",
    }
    for command in COMPLETIONS["commands"]:
        base = "metric up" if command == "rate" else "search"
        engine.query(f"{base} | {arguments.get(command, command)}")
    for f in COMPLETIONS["aggregates"]:
        engine.query(f"search | stats {f}" + "(host)" * (f != "count"))
    for op in COMPLETIONS["operators"]:
        engine.query(f"search host{op}a")
    assert engine.collect("search | head 3", limit=2).stats["truncated"]


def test_pages(engine):
    first = engine.page("search", 2).collect()
    assert [r["id"] for r in first] == [5, 3]
    assert [r["id"] for r in engine.page("search", 9, (first[-1]["ts"], first[-1]["id"])).collect()] == [2, 1, 4]
    with pytest.raises(QueryError, match="ts and id"):
        engine.page("search | stats count", 2)


@pytest.mark.parametrize("by", ["", " by host"])
@pytest.mark.parametrize("measure", ["count", "sum(severity)", "avg(severity)", "min(dport)", "max(severity)", "dc(host)", "values(category)", "list(category)"])
def test_eventstats_of_limited_rows(engine, measure, by):
    """The rows that a limit picks are read once, so that each row finds its group."""
    name = measure.split("(")[0]
    got = rows(engine, f"search | head 4 | eventstats {measure}{by} | table ts,{name}")
    assert len(got) == 4
    want = rows(engine, f"search | eventstats {measure}{by} | table ts,{name}")
    assert [type(r[1]) for r in got if r[1] is not None] == [type(want[0][1] or r[1]) for r in got if r[1] is not None]
    limits = lambda text: engine.query(text)._jdf.queryExecution().optimizedPlan().toString().count("GlobalLimit")
    assert limits(f"search | head 4 | eventstats {measure}{by}") == 1
    assert limits(f"search | append [search | head 2] | eventstats {measure}{by}") == 1


def test_names_that_stages_use_are_free(engine):
    for name in ("_made", "_k0", "_l0", "_row", "_rise", "_key", "_lk", "_o_team", "made", "before"):
        assert rows(engine, f"search host=a | eval {name} = 1 | eventstats count by {name} | table {name},count") == [(1, 2), (1, 2)]
        assert rows(engine, f"search host=a | eval {name} = 1 | dedup {name} | join {name} [search | eval {name} = 1 | stats list(host) by {name}] | lookup owners host OUTPUT team | table {name},list,team") == [(1, "a,a,b,b", "red")]
    assert rows(engine, "metric up job=api by job | eval _rise = 7 | rate | table ts,_rise,rate")[1] == (1, 7, 3.0)


def test_rate_of_equal_times(engine, spark):
    m = [(1, "h", "up", "{}", float(v)) for v in (9, 5, 7)] + [(2, "h", "up", "{}", 12.0)]
    for seed in range(3):
        random.Random(seed).shuffle(m)
        own = Engine(engine.catalog.with_tables(metric=spark.createDataFrame(m, METRIC).repartition(3), metric_rollup=engine.catalog.table("metric_rollup").limit(0)), events())
        assert rows(own, "metric up | rate | table ts,value,rate") == [(1, 5.0, None), (1, 7.0, None), (1, 9.0, None), (2, 12.0, 3.0)]


@pytest.mark.parametrize("function", ["values", "list"])
def test_lists_are_cut(engine, spark, function):
    rnd = random.Random(4)
    data = [(g, rnd.choice(["", "x" * rnd.randint(0, 900), f"v{rnd.randint(0, 3000)}", None])) for g in ("a", "b", None) for _ in range(rnd.choice((20, 3000)))] + [("none", None), ("long", "z" * 9000), ("long", "z" * 9000)]
    own = Engine(engine.catalog.with_tables(event=conform(spark.createDataFrame(data, "host string, message string"), EVENT)), events())
    want = {}
    for g, v in data:
        want.setdefault(g, [])
        want[g] += [] if v is None else [v]
    cut = {g: ",".join(sorted(set(v) if function == "values" else v))[:4096] if v else None for g, v in want.items()}
    assert dict(rows(own, f"search | stats {function}(message) by host | table host,{function}")) == cut
    every = [v for vs in want.values() for v in vs]
    assert rows(own, f"search | stats {function}(message)") == [(",".join(sorted(set(every) if function == "values" else every))[:4096],)]


def test_time_bounds_reach_files(spark, engine, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("time_window", "metric_window"):
        text = plan(run(name, spark, "/root/testdata/sf0.001"))
        assert "GreaterThanOrEqual(ts,2024-01-1" in text and "LessThan(ts,20" in text
    store = Store(str(tmp_path))
    store.insert_events(engine.catalog.table("event").withColumn("ts", engine.catalog.table("event").ts * 1000))
    own = Engine(store.catalog(spark), events())
    found = own.query("search", 90_000, 320_000)
    assert "PartitionFilters: [isnotnull(day" in plan(found) and [r["ts"] for r in found.orderBy("ts").collect()] == [100_000, 200_000, 300_000]
    assert own.query("metric up").columns and Engine(engine.catalog, events()).query("search", 100, 300).count() == 3


def test_masks_must_be_known(engine):
    with pytest.raises(QueryError, match="known"):
        engine.masked(None)
    assert engine.masked({}).query("host=a").count() == 2
    assert {r["host"] for r in engine.masked({"host": "mask"}).masked({}).query("search").collect()} == {"***", None}
    assert ids(engine, "search", schema=engine.within("dev").schema) == [3]


def test_budget_and_cancel(spark, engine):
    slow = Engine(engine.catalog.with_tables(event=conform(spark.range(60_000_000).selectExpr("id as ts", "sha2(sha2(string(id), 512), 512) as message"), EVENT)), events())
    began = time.monotonic()
    with pytest.raises(QueryError, match="budget"):
        slow.collect("search zzzz | stats dc(message)", budget_ms=1500)
    done = threading.Event()

    def cancel():
        while not done.wait(0.5):
            Engine.cancel(spark, "mine")

    threading.Thread(target=cancel).start()
    with pytest.raises(QueryError, match="cancelled"):
        slow.collect("search zzzz | stats dc(message)", tag="mine")
    done.set()
    assert time.monotonic() - began < 60
    assert engine.collect("search", budget_ms=60_000, tag="mine").stats["rows"] == 5


def test_entry_without_a_library_of_the_training_data_queries(monkeypatch):
    """What only those queries need may be missing; a module of this package may not."""
    real = __import__

    def without(missing):
        def found(name, *a, **k):
            if name == "sluice.llm" or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *a, **k)

        return found

    monkeypatch.setattr("builtins.__import__", without("public_tokenizers"))
    with pytest.warns(UserWarning, match="public_tokenizers"):
        assert "flt_eq" in __spark_entry__.queries()
    monkeypatch.setattr("builtins.__import__", without("sluice.llm"))
    assert "flt_eq" in __spark_entry__.queries()
    monkeypatch.setattr("builtins.__import__", without("sluice.llm.links"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
