"""Every query with SQL against DuckDB on the smallest tables, and the entry contract."""

import math

import pytest

import __spark_entry__ as entry
from basalt.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    have = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall()) == have


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "weighted_grade" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["fallas_equipo_semana"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    columns = plan.split("ReadSchema: struct<", 1)[1].split(">")[0]
    assert "event_id" in columns and "ts:" in columns and "value:double" not in columns


def test_long_lines_are_split_not_dropped(spark):
    from basalt.functions.text import split_recursive

    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for n, line in enumerate((r.text or "").split("\n"), 1):
            if line.strip(" "):
                parts = [line] if len(line) <= 900 else split_recursive(line, 900, 150)
                want += [(f"{r.doc_id}#line#{n:03d}"[: len(f"{r.doc_id}#line#") + 3], k, f"[{r.source or ''} · {r.lang or ''}] {p}") for k, p in enumerate(parts)]
    got = catalogue.QUERIES["chunk_by_genre"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.part for r in got)
