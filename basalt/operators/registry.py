"""Model registry on versioned tables: runs with metrics, model versions, aliases, promotion events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from basalt.operators.tables import VersionedTable


def _schema(*fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


METRICS = _schema(("run", StringType()), ("metric", StringType()), ("value", DoubleType()))
VERSIONS = _schema(("model", StringType()), ("version", LongType()), ("run", StringType()), ("path", StringType()))
ALIASES = _schema(("model", StringType()), ("alias", StringType()), ("version", LongType()))
EVENTS = _schema(("model", StringType()), ("n", LongType()), ("outcome", StringType()), ("staging_error", DoubleType()), ("production_error", DoubleType()))


@dataclass
class Registry:
    """One writer at a time is assumed, as for the tables below it."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        table = lambda name, schema, key: VersionedTable(self.spark, f"{self.path}/{name}", schema, key)
        self.metrics, self.versions = table("metrics", METRICS, ["run", "metric"]), table("versions", VERSIONS, ["model", "version"])
        self.aliases, self.events = table("aliases", ALIASES, ["model", "alias"]), table("events", EVENTS, ["model", "n"])

    def _frame(self, rows: list[tuple], schema: StructType) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def log_run(self, run: str, metrics: dict[str, float]) -> None:
        self.metrics.insert_missing(self._frame([(run, k, float(v)) for k, v in metrics.items()], METRICS))

    def register(self, model: str, run: str, path: str) -> int:
        last = self.versions.read().where(F.col("model") == model).agg(F.max("version")).first()[0] or 0
        self.versions.append(self._frame([(model, last + 1, run, path)], VERSIONS))
        return last + 1

    def set_alias(self, model: str, alias: str, version: int) -> None:
        self.aliases.merge_full(self._frame([(model, alias, version)], ALIASES), F.lit(False))

    def resolve(self, model: str, alias: str) -> int | None:
        row = self.aliases.read().where((F.col("model") == model) & (F.col("alias") == alias)).first()
        return row and row.version

    def error(self, model: str, version: int | None, metric: str) -> float | None:
        runs = self.versions.read().where((F.col("model") == model) & (F.col("version") == version)).select("run")
        row = self.metrics.read().where(F.col("metric") == metric).join(runs, "run").first()
        return row and row.value

    def decide(self, model: str, metric: str) -> str:
        """Production moves to staging's version if its error is strictly lower; the event is logged either way."""
        staging, production = self.resolve(model, "staging"), self.resolve(model, "production")
        s, p = self.error(model, staging, metric), self.error(model, production, metric)
        outcome = "promote" if s is not None and (p is None or s < p) else "rollback"
        if outcome == "promote":
            self.set_alias(model, "production", staging)
        n = self.events.read().where(F.col("model") == model).count()
        self.events.append(self._frame([(model, n, outcome, s, p)], EVENTS))
        return outcome
