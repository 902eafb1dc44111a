"""The cost model's published figures."""

import pytest

from basalt.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def rows(spark, name, *key):
    return {tuple(r[k] for k in key): r for r in QUERIES[name](spark, SF).collect()}


def test_totals_and_shares(spark):
    found = rows(spark, "cost_estimate", "scenario", "line")
    total = lambda s: round(sum(r["usd"] for (scenario, _), r in found.items() if scenario == s))
    assert (total("low"), total("high")) == (17_962, 42_719)
    share = lambda s: round(100 * found[s, "capacity and licences"]["share"], 1)
    assert (share("low"), share("high")) == (65.2, 50.9)
    assert round(found["low", "ingest"]["usd"]) == 1_161


def test_sensitivity_to_drone_volume(spark):
    found = rows(spark, "cost_sensitivity", "scenario", "factor")
    assert round(found["low", 1]["total"]) == 17_962 and round(found["high", 1]["total"]) == 42_719
    assert round(100 * found["high", 10]["storage_share"], 1) == 26.0
    assert all(found[s, 1]["storage_share"] < 0.04 for s in ("low", "high"))


def test_volume(spark):
    whole = rows(spark, "cost_volumetry", "source")["all",]
    assert (whole["signals"], whole["readings_year"], whole["readings_day"]) == (760, 798_912_000, 2_188_800)
    assert (round(whole["gb_low"], 1), round(whole["gb_high"], 1)) == (29.8, 89.3)
    assert rows(spark, "cost_lab_analyses", "mines", "every_hours")[3, 4]["analyses_year"] == 6_570


def test_capacity_cluster_storage(spark):
    eight = rows(spark, "cost_capacity", "units")[8,]
    assert round(100 * eight["discount"], 1) == 40.5 and round(eight["break_even_viewers"]) == 313 and round(eight["saving_40_viewers"]) == 45_808
    found = rows(spark, "cost_cluster", "tier", "machine", "hours_day")
    assert found["jobs", "on demand", 3]["node_hour"] == pytest.approx(0.526) and round(100 * found["jobs", "on demand", 3]["machine_surcharge"]) == 75
    assert found["jobs", "on demand", 0]["yearly"] == 0 and found["jobs", "spot", 6]["yearly"] == pytest.approx(2 * found["jobs", "spot", 3]["yearly"])
    storage = rows(spark, "cost_storage", "scenario")
    assert (round(storage["low",]["total"]), round(storage["high",]["total"])) == (396, 1_546)


def test_ingest_assistant_rates(spark):
    (row,) = QUERIES["cost_ingest"](spark, SF).collect()
    assert (row["s1_units"], row["s1_year"], row["s2_year"]) == (6, 1_800, 3_000)
    assert round(row["s1_year"] - row["hub_year"]) == 639 and round(row["s2_year"] - row["hub_year"]) == 1_839
    found = rows(spark, "cost_assistant", "model")
    assert (found["small",]["indexing"], found["small",]["queries_year"], found["frontier",]["queries_year"]) == pytest.approx((1.04, 12.483, 262.8))
    assert all(r["unit"] and r["source"] and r["usd"] > 0 for r in QUERIES["cost_rates"](spark, SF).collect())
