"""All named queries, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.plans import cost, eda, lakehouse, modelling, search, stateful, text, windows
from basalt.plans.dialect import DUCK, SPARK, Dialect

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def relational(build: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables of a folder, planned by Catalyst from the dialect's SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = build(SPARK)
        for t in TABLES:
            if t in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return query


_SQL = {**lakehouse.QUERIES, **modelling.QUERIES, **eda.QUERIES, **text.QUERIES, **cost.QUERIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: relational(b) for k, b in _SQL.items()} | search.QUERIES | windows.QUERIES | stateful.QUERIES
ORACLES: dict[str, str] = {k: b(DUCK) for k, b in _SQL.items()} | stateful.ORACLES
