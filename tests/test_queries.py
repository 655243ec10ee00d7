"""Every registered query of the language against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from sluice.plans.queries import oracle_sql, run

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sql, name):
    df = run(name, spark, str(DATA))
    want = sql.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())


def test_time_does_not_depend_on_the_session_zone(spark):
    want = sorted(run("ts_span", spark, str(DATA)).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(run("ts_span", spark, str(DATA)).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
