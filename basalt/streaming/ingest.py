"""File ingest: explicit-schema CSV with a rescue column, in batch and as a stream of one file a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
RESCUE = "_rescued_data"


class SchemaMismatch(ValueError):
    """A frame's columns or types differ from what is declared."""


def _options(reader, schema: StructType):
    rescued = StructType([*schema.fields, StructField(RESCUE, StringType())])
    return reader.schema(rescued).option("header", True).option("timestampFormat", TS_FORMAT).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", RESCUE)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Malformed rows become nulls with the line kept in the rescue column; the file's path is added."""
    return _options(spark.read, schema).csv(path).withColumn("source_file", F.col("_metadata.file_path"))


def assert_schema(df: DataFrame, schema: StructType) -> None:
    """Names and types both ways, whatever the order and nullability."""
    have, want = {(f.name, f.dataType.simpleString()) for f in df.schema}, {(f.name, f.dataType.simpleString()) for f in schema}
    if have != want:
        raise SchemaMismatch(f"missing {sorted(want - have)}, unexpected {sorted(have - want)}")


def enrich(df: DataFrame, batch: str) -> DataFrame:
    """Ingest columns; works on batch and streaming frames alike."""
    return df.withColumns({"ts_ingest": F.current_timestamp(), "date_ingest": F.current_date(), "batch_id": F.lit(batch)})


def stream_to_table(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, batch: str) -> int:
    """Take in what is new under source, one file a micro-batch, then stop; rows taken in.

    The checkpoint remembers the files, so a second run takes nothing; the file sink's log makes each batch whole.
    """
    stream = _options(spark.readStream.option("maxFilesPerTrigger", 1), schema).csv(source).withColumn("source_file", F.col("_metadata.file_path"))
    query = enrich(stream, batch).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return sum(int(p["numInputRows"]) for p in query.recentProgress)
