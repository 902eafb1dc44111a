"""Queries that go through the table layer, the stream, or operators SQL has no words for."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from basalt.functions.text import FACTS, page_blocks, split_column, strip_accents
from basalt.operators.gold import refresh
from basalt.operators.registry import Registry
from basalt.operators.storage import scratch
from basalt.operators.tables import VersionedTable
from basalt.plans.dialect import DUCK, SPARK, Dialect, tele
from basalt.plans.modelling import label, split
from basalt.streaming.ingest import read_csv, stream_to_table

EVENTS = StructType([StructField(n, t) for n, t in (("event_id", LongType()), ("us", LongType()), ("front", StringType()), ("sector", StringType()), ("local_date", DateType()), ("shift", StringType()), ("year_month", StringType()), ("mineral", StringType()), ("grade", DoubleType()), ("tons", DoubleType()), ("failure_code", StringType()))])
COLUMNS = ", ".join(EVENTS.fieldNames())

MAX_CHUNK, OVERLAP = 900, 150


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in ("events", "documents", "pages", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, f"with {tele(SPARK)} select {COLUMNS} from tele")


def silver_table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Version 0: even events; version 1: the others inserted."""
    table = VersionedTable(spark, scratch(spark, "silver"), EVENTS, ["event_id"], "year_month")
    rows = events(spark, sf_dir)
    table.append(rows.where("event_id % 2 = 0"))
    table.insert_missing(rows)
    return table


def relabel(table: VersionedTable, rows: DataFrame) -> int | None:
    """One event in 37 becomes MIX."""
    source = rows.where("event_id % 37 = 0").select("event_id", F.lit("MIX").alias("lab"))
    return table.update_where(source, lambda t, s: {"mineral": s["lab"]}, lambda t, s: t["mineral"] != s["lab"])


def time_travel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = silver_table(spark, sf_dir)
    relabel(table, events(spark, sf_dir))
    a, b = table.read(1).select("event_id", F.col("mineral").alias("before")), table.read(2).select("event_id", F.col("mineral").alias("after"))
    return a.join(b, "event_id").where("before <> after")


def change_feed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = silver_table(spark, sf_dir)
    relabel(table, events(spark, sf_dir))
    return table.changes(1).groupBy("_change_type", "front", "local_date", "shift").agg(F.count("*").alias("n")).withColumnRenamed("_change_type", "change_type")


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = silver_table(spark, sf_dir)
    relabel(table, events(spark, sf_dir))
    return table.history().select("version", "operation", "n_partitions")


def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full build, a correction and a deletion on silver, then a refresh of the cells they touch."""
    silver = silver_table(spark, sf_dir)
    cells = refresh(spark, silver, scratch(spark, "gold"))
    relabel(silver, events(spark, sf_dir))
    silver.delete_where(F.col("event_id") % 101 == 0)
    cells = refresh(spark, silver, cells.path)
    return cells.read()


def _after_changes(d: Dialect) -> str:
    return f"with {tele(d)}, now as (select event_id, us, front, sector, local_date, shift, case when event_id % 37 = 0 then 'MIX' else mineral end as mineral, grade, tons, failure_code from tele where event_id % 101 <> 0)"


def csv_rescue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV with some malformed lines, read back under the declared schema."""
    path = scratch(spark, "csv")
    rows = events(spark, sf_dir)
    good = F.concat_ws(",", "event_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"), "front", F.col("tons").cast("string"))
    rows.select(F.when(F.col("event_id") % 100 == 0, F.concat(good, F.lit(",extra"))).otherwise(good).alias("event_id,ts,front,tons")).write.option("header", True).option("quote", "").csv(path)
    schema = StructType.fromDDL("event_id long, ts timestamp, front string, tons double")
    found = read_csv(spark, path, schema)
    return found.groupBy((F.col("_rescued_data").isNotNull()).alias("rescued")).agg(F.count("*").alias("n"), F.round(F.sum("tons"), 3).alias("tons"))


def stream_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files come in one a micro-batch; a second run finds nothing."""
    source, target, checkpoint = scratch(spark, "landing"), scratch(spark, "bronze"), scratch(spark, "offsets")
    rows = events(spark, sf_dir).select("event_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "front", "tons")
    rows.repartition(3, "event_id").write.option("header", True).csv(source)
    schema = StructType.fromDDL("event_id long, ts timestamp, front string, tons double")
    for run in range(2):
        stream_to_table(spark, source, schema, target, checkpoint, f"L{run}")
    return spark.read.parquet(target).groupBy("front", "batch_id").agg(F.count("*").alias("n"), F.round(F.sum("tons"), 3).alias("tons"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(page_blocks(F.col("html"))).alias("n", "block")).select("page_id", F.col("n").cast("long").alias("n"), "block.kind", "block.text")


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return split_column(docs, "text", 800, 120).select("doc_id", "n", F.length("chunk").cast("long").alias("n_chars"))


def chunk_by_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under a context prefix; a line over MAX_CHUNK characters is split recursively, none is dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = docs.where(F.trim("line") != "").withColumnRenamed("n", "at")
    parts = split_column(lines, "line", MAX_CHUNK, OVERLAP, whole=True).withColumnRenamed("n", "part")
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit("#line#"), F.lpad((F.col("at") + 1).cast("string"), 3, "0"))
    body = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit(" · "), F.coalesce("lang", F.lit("")), F.lit("] "), "chunk")
    return parts.select(chunk_id.alias("chunk_id"), F.col("part").cast("long").alias("part"), body.alias("body"))


def fact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and codes of each benchmark item against the document of the same id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.col("text").alias("answer"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    facts = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FACTS), F.lit(0)))
    missing = F.array_except(facts(F.col("answer")), facts(F.col("text")))
    return items.join(docs, "doc_id").select("doc_id", F.size(missing).cast("long").alias("n_missing"), (F.size(missing) == 0).alias("verified"))


def gbt_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees on the development shifts, evaluated on the test shifts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    columns = ["grade", "grade_mean3", "grade_mean10", "n_events", "idle_min"]
    rows = lambda part: frame(spark, sf_dir, f"with {split(SPARK)} select {', '.join(columns)}, target from {part}").fillna(0.0)
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), GBTRegressor(labelCol="target", maxIter=8, maxDepth=3, seed=20250506)]
    scored = Pipeline(stages=stages).fit(rows("dev")).transform(rows("test"))
    return scored.agg(F.round(F.avg(F.abs(F.col("target") - F.col("prediction"))), 6).alias("mae"), F.count("*").alias("n"))


def gbt_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted gradient-boosted classifier of the 4-hour failure label; what permuting each input costs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = ["n_events", "n_failures", "max_vibration", "temp"]
    rows = frame(spark, sf_dir, f"with {label(SPARK)} select front, start_us, {', '.join(columns)}, cast(y as double) as y from labelled")
    cut, positive = rows.agg(F.expr("percentile(start_us, 0.8e0)"), F.avg("y")).first()
    weight = (1 - positive) / positive if positive else 1.0
    rows = rows.withColumn("w", F.when(F.col("y") > 0, weight).otherwise(1.0))
    train, test = rows.where(F.col("start_us") <= cut), rows.where(F.col("start_us") > cut)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTClassifier(labelCol="y", weightCol="w", maxIter=5, maxDepth=3, seed=20250506)]).fit(train)

    def brier(df: DataFrame, name: str) -> DataFrame:
        p = model.transform(df).select("y", vector_to_array("probability")[1].alias("p"))
        return p.agg(F.lit(name).alias("permuted"), F.round(F.avg((F.col("y") - F.col("p")) ** 2), 6).alias("brier"))

    out = brier(test, "none")
    for c in columns:
        # every value moves to another row of its front, so the column keeps its distribution
        moved = test.withColumn(c, F.coalesce(F.lag(c, 7).over(Window.partitionBy("front").orderBy("start_us")), F.col(c)))
        out = out.unionByName(brier(moved, c))
    return out


def promotion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three registrations of a model, each staged and decided on."""
    registry = Registry(spark, scratch(spark, "registry"))
    for run, error in (("r1", 0.40), ("r2", 0.35), ("r3", 0.37)):
        registry.log_run(run, {"mae": error})
        registry.set_alias("grade", "staging", registry.register("grade", run, f"models/{run}"))
        registry.decide("grade", "mae")
    return registry.events.read()


def accent_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang in ('es', 'fr', 'de')")
    return docs.select("doc_id", F.length(strip_accents(F.col("text"))).cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (time_travel_diff, change_feed_cells, table_history, gold_incremental, csv_rescue_scan, stream_file_ingest, page_elements, chunk_fixed, chunk_by_genre, fact_verification, gbt_grade, gbt_failure, promotion_log, accent_folding)}
ORACLES = {
    "time_travel_diff": f"with {tele(DUCK)} select event_id, mineral as before, 'MIX' as after from tele where event_id % 37 = 0 and mineral <> 'MIX'",
    "promotion_log": "select 'grade' as model, cast(n as bigint) as n, outcome, staging_error, production_error from (select 0 as n, 'promote' as outcome, 0.40e0 as staging_error, cast(null as double) as production_error union all select 1, 'promote', 0.35e0, 0.40e0 union all select 2, 'rollback', 0.37e0, 0.35e0) as x",
    "change_feed_cells": f"with {tele(DUCK)} select t as change_type, front, local_date, shift, count(*) as n from tele cross join (select 'update_preimage' as t union all select 'update_postimage') as x where event_id % 37 = 0 and mineral <> 'MIX' group by 1, 2, 3, 4",
    "gold_incremental": f"{_after_changes(DUCK)} select front, local_date, shift, count(*) as n_events, round(sum(tons), 6) as tons, round(sum(grade * tons) / sum(case when grade is not null then tons end), 6) as weighted_grade, count(failure_code) as n_failures, cast(sum(case when mineral = 'MIX' then 1 else 0 end) as bigint) as n_mix from now group by front, local_date, shift",
    "csv_rescue_scan": f"with {tele(DUCK)} select event_id % 100 = 0 as rescued, count(*) as n, round(sum(tons), 3) as tons from tele group by 1",
    "stream_file_ingest": f"with {tele(DUCK)} select front, 'L0' as batch_id, count(*) as n, round(sum(tons), 3) as tons from tele group by front",
}
