"""The table layer: versions, merges, change feed, partition rewrite."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from basalt.operators.storage import scratch
from basalt.operators.tables import DuplicateKeys, VersionedTable

SCHEMA = StructType([StructField("id", LongType()), StructField("part", StringType()), StructField("x", DoubleType())])


@pytest.fixture
def table(spark):
    t = VersionedTable(spark, scratch(spark, "t"), SCHEMA, ["id"], "part")
    t.append(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0)], SCHEMA))
    return t


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_missing_is_idempotent(spark, table):
    source = spark.createDataFrame([(1, "a", 9.0), (5, "b", 5.0)], SCHEMA)
    assert table.insert_missing(source) == 1
    assert table.insert_missing(source) is None and table.version() == 1
    assert table.read().where("id = 1").first().x == 1.0 and table.read().count() == 5


def test_update_rewrites_touched_partitions_only(spark, table):
    before = table.manifest()["partitions"]
    source = spark.createDataFrame([(1, 7.0), (2, 2.0)], "id long, y double")
    v = table.update_where(source, lambda t, s: {"x": s["y"]}, lambda t, s: t["x"] != s["y"])
    m = table.manifest(v)
    assert m["metrics"]["updated"] == 1 and m["metrics"]["partitions_rewritten"] == 1
    assert m["partitions"]["b"] == before["b"] and m["partitions"]["a"] != before["a"]
    assert rows(table.changes(0).select("id", "x", "_change_type")) == [(1, 1.0, "update_preimage"), (1, 7.0, "update_postimage")]
    assert table.read(0).where("id = 1").first().x == 1.0


def test_null_never_updates(spark, table):
    source = spark.createDataFrame([(1, None)], "id long, y double")
    assert table.update_where(source, lambda t, s: {"x": s["y"]}, lambda t, s: t["x"] != s["y"]) is None


def test_merge_full(spark, table):
    source = spark.createDataFrame([(1, "a", None), (2, "a", 8.0), (9, "c", 9.0)], SCHEMA)
    table.merge_full(source, F.col("x").isNull())
    assert rows(table.read().where("part is not null")) == [(2, "a", 8.0), (3, "b", 3.0), (9, "c", 9.0)]
    assert table.read().count() == 4
    with pytest.raises(DuplicateKeys):
        table.merge_full(source.union(source), F.lit(False))


def test_delete_whole_partition_and_history(spark, table):
    table.delete_where(F.col("part") == "a")
    assert set(table.manifest()["partitions"]) == {"b", "_null"}
    assert table.delete_where(F.col("part") == "zzz") is None
    assert [r.operation for r in table.history().orderBy("version").collect()] == ["append", "delete_where"]


def test_incremental_refresh_equals_full(spark):
    from basalt.operators.gold import cells, refresh
    from basalt.plans.stateful import events, relabel, silver_table

    sf = "/root/testdata/sf0.001"
    silver = silver_table(spark, sf)
    gold = refresh(spark, silver, scratch(spark, "g"))
    relabel(silver, events(spark, sf))
    silver.delete_where(F.col("front") == "FR-3")
    gold = refresh(spark, silver, gold.path)
    assert rows(gold.read()) == rows(cells(silver.read()).select(*gold.read().columns))
    metrics = [gold.manifest(v)["metrics"] for v in range(gold.version() + 1) if gold.manifest(v)["operation"] == "merge_full"]
    assert metrics[0]["deleted"] > 0
    assert refresh(spark, silver, gold.path).version() == gold.version()


def test_a_partition_is_written_by_many_tasks(spark):
    """All rows of one partition must not meet in one task's memory."""
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = VersionedTable(spark, scratch(spark, "wide"), SCHEMA, ["id"], "part")
        t.append(spark.range(1000).selectExpr("id", "'a' as part", "1.0e0 as x"))
        files = [f for f in t.read().inputFiles() if "_slot=a" in f]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(files) > 1 and t.read().count() == 1000 and set(t.manifest()["partitions"]) == {"a"}
