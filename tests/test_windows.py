"""Looking back and ahead in time: brute force, and plans that meet no row with all its neighbours."""

import os
import random

import numpy as np
import pytest

from basalt.operators.rolling import before, kth, week_before
from basalt.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_kth_least_of_ranges():
    draw = np.random.default_rng(2)
    ranks = draw.integers(0, 37, 200)
    lo = draw.integers(0, 199, 300)
    hi = np.array([draw.integers(a + 1, 201) for a in lo])
    k = np.array([draw.integers(0, b - a) for a, b in zip(lo, hi)])
    assert kth(ranks, lo, hi, k).tolist() == [sorted(ranks[a:b])[i] for a, b, i in zip(lo, hi, k)]


@pytest.mark.parametrize("odd", [1.0, float("nan")])
def test_before_against_brute_force(odd):
    draw = np.random.default_rng(4)
    us, x, at = draw.integers(0, 300, 150), np.append(draw.integers(-9, 99, 149) / 10, odd), draw.integers(-20, 400, 80)
    n, mean, median = before(us, x, at, 40)
    for i, t in enumerate(at):
        part = x[(us >= t - 40) & (us < t)]
        assert n[i] == len(part)
        want = (part.mean(), np.median(part)) if len(part) else (np.nan, np.nan)
        if not np.isnan(part).any():
            assert np.allclose((mean[i], median[i]), want, equal_nan=True)
        else:
            assert np.isnan(mean[i])


def test_rows_without_key_or_time_look_at_nothing(spark):
    rows = [(1, "a", 10, 1.0), (2, "a", 20, None), (3, None, 15, 2.0), (4, None, 20, None), (5, "a", None, None), (6, "a", None, 3.0), (7, "a", 500, None)]
    got = week_before(spark.createDataFrame(rows, "event_id long, front string, us long, grade double"), ["front"], "grade is null", 50).collect()
    assert sorted((r.event_id, r.n, r.median) for r in got) == [(2, 1, 1.0), (4, 0, None), (5, 0, None), (7, 0, None)]


@pytest.mark.parametrize("name", ["impute_window_median", "eda_mean_vs_median"])
def test_no_row_a_neighbour(spark, name):
    assert "Join" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_failures_ahead_across_midnight(spark, tmp_path):
    """Times on both sides of midnight, exactly four hours apart, equal and missing, against the SQL."""
    duckdb = pytest.importorskip("duckdb")
    pick = random.Random(8)
    hours = [0, 4, 20, 24, 28, 44, 48]
    rows = [(10 * i, None if i % 11 == 0 else pick.choice(hours) * 3_600_000_000 + pick.choice([-1, 0, 0, 1]), 1, pick.choice(["error", "view"]), 1.0, '{"k": 3}') for i in range(120)]
    spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(timestamp_micros(us + 1704067200000000) as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    os.symlink(f"{SF}/part.parquet", f"{tmp_path}/part.parquet")  # read wherever the SQL says "partition"
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = catalogue.QUERIES["event_failure_4h"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(catalogue.ORACLES["event_failure_4h"]).fetchall())
    assert "specifiedwindowframe(RangeFrame, 1" not in df._jdf.queryExecution().executedPlan().toString()


def test_means_without_a_window_of_all_rows(spark):
    assert "Window" not in catalogue.QUERIES["eda_r2_group_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
