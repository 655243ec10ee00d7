"""The registered queries: SQL where there is some, the pipeline against its stages' plain versions."""

import duckdb
import pytest

import plain

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sluice.llm import registry, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.scores(docs, model).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected]
    rows = [(i, t) for i, _, _, t in plain.kept_lines(rows)]
    first = plain.classes(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {c[0] for c in plain.contamination(rows, items) if not c[4]}
    want = {i: plain.sha(t) for i, t in rows if i in clean}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, name, stage):
    """Nulls, empty and repeated texts, ties, columns with the operators' own names, an empty table."""
    long = "\n".join(f"a line of the same words again and again, number {i % 7}" for i in range(200))
    rows = [(1, "x y z"), (1, "x y z"), (2, None), (3, ""), (None, "no key"), (None, "no key"), (None, None), (4, long), (5, long), (5, "another text of one key"), (6, long), (7, long), (8, long + "\nand a line of its own")]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, h bigint, node int, dropped int, label string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 1, 2, 3, "l") for i, t in rows], names)
    got = stage(spark, docs, DATA)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or got.columns == docs.columns
    kept = got.collect()
    count = {"toxicity": 13, "line_dedup": 13, "minhash_near_dedup": 5, "decontamination": 13, "byte_bpe": 13}
    assert len(kept) == count[name]
    if name == "line_dedup":
        assert {(r["doc_id"], r["text"], r["n_chars"]) for r in kept if r["doc_id"] == 4} == {(4, "", 0)}
        assert {r["text"] for r in kept if r["doc_id"] in (2, 3)} == {None, ""}
    if name == "minhash_near_dedup":
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "no key"), (1, "x y z"), (2, ""), (4, long), (5, "another text of one key")]
    assert stage(spark, docs.limit(0), DATA).count() == 0
