"""Incremental maintenance of KPI cells from a silver table's change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from basalt.operators.tables import VersionedTable

CELL = ["front", "local_date", "shift"]
SCHEMA = StructType([StructField(n, t) for n, t in (("front", StringType()), ("local_date", DateType()), ("shift", StringType()), ("n_events", LongType()), ("tons", DoubleType()), ("weighted_grade", DoubleType()), ("n_failures", LongType()), ("n_mix", LongType()))])
PROCESSED = "silver_version"


def cells(silver: DataFrame) -> DataFrame:
    graded = F.sum(F.when(F.col("grade").isNotNull(), F.col("tons")))
    return silver.groupBy(*CELL).agg(
        F.count("*").alias("n_events"),
        F.round(F.sum("tons"), 6).alias("tons"),
        F.round(F.sum(F.col("grade") * F.col("tons")) / F.when(graded > 0, graded), 6).alias("weighted_grade"),
        F.count("failure_code").alias("n_failures"),
        F.sum(F.when(F.col("mineral") == "MIX", 1).otherwise(0)).cast("long").alias("n_mix"),
    )


def refresh(spark: SparkSession, silver: VersionedTable, path: str) -> VersionedTable:
    """Bring gold up to silver's version: all of it the first time, then only the cells its change rows name.

    Keys come from pre- and postimages, so an event that moved refreshes the cell it left; a cell without events goes.
    """
    gold = VersionedTable(spark, path, SCHEMA, CELL)
    now, seen = silver.version(), gold.manifest()["properties"].get(PROCESSED)
    if seen == now:
        return gold
    if seen is None:
        gold.overwrite(cells(silver.read(now)).repartitionByRange("front", "local_date"), sort=["front", "local_date"])
    else:
        touched = silver.changes(seen, now).select(*CELL).distinct()
        fresh = cells(silver.read(now).join(touched, CELL, "left_semi"))
        gold.merge_full(touched.join(fresh, CELL, "left"), F.col("n_events").isNull())
    gold.set_property(PROCESSED, now)
    return gold
