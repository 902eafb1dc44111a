"""Queries over the week before each row, by ``operators.rolling``; their SQL joins every row with its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.operators.rolling import week_before
from basalt.plans import eda
from basalt.plans.dialect import SPARK, WEEK_US, tele


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(f"with {tele(SPARK)} select event_id, front, mineral, us, grade from tele")


def impute_window_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = week_before(readings(spark, sf_dir), ["front", "mineral"], "grade is null", WEEK_US)
    return near.selectExpr("event_id", "case when n >= 5 then round(median, 6) end as grade", "n < 5 as flag_imputed")


def eda_mean_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = week_before(readings(spark, sf_dir), ["front"], "grade is not null", WEEK_US)
    near.selectExpr("event_id", "grade", "mean as m", "median as med", "n").createOrReplaceTempView("near")
    return spark.sql(eda.ERRORS)


QUERIES = {f.__name__: f for f in (impute_window_median, eda_mean_vs_median)}
