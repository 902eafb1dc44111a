"""Shared plumbing of the training-data operators.

Texts are handled as UTF-8 bytes; a null text is an empty one.  A word is a run of bytes other than ASCII white
space (0x20, 0x09-0x0D), which is exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD_RE = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"
BATCH_ROWS = 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL_DIRS: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id's text modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(divisor)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a private one where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="basalt-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return f"file://{_LOCAL_DIRS[0]}"


def stage(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that survive lost executors.

    batch_rows: rows of the Arrow batches within df's plan.
    """
    spark = df.sparkSession
    spark.conf.set(ARROW_ROWS, str(batch_rows))
    path = f"{shared_dir(spark)}/basalt-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return spark.read.schema(df.schema).parquet(path)


_PROCESS: dict = {}
_WANTED: set = set()


def process_cache(key, make: Callable):
    """What a reused worker keeps from task to task under key; it holds one key at a time.

    Call it from an Arrow map's ``function``: a worker drops what the map it runs next does not ask for.
    """
    _WANTED.add(key)
    if key not in _PROCESS:
        _PROCESS.clear()
        _PROCESS[key] = make()
    return _PROCESS[key]


def _started(function: Callable, *args):
    _WANTED.clear()
    step = function(*args)
    for key in _PROCESS.keys() - _WANTED:
        del _PROCESS[key]
    return step


def as_bytes(column: pa.Array) -> list[bytes]:
    """The batch's texts as bytes; null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, function: Callable, schema: str | StructType, *args) -> DataFrame:
    """Arrow map: ``function(*args)`` is called once a task and returns batch -> {column: values}."""
    spark = df.sparkSession
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _started(function, *args)
        for batch in batches:
            yield _batch(step(batch), arrow)

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Arrow map over a task's whole stream of batches: ``function(batches)`` yields {column: values}."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _started(function, batches):
            yield _batch(part, arrow)

    return df.mapInArrow(run, schema)


def _batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in arrow]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def share(spark: SparkSession, value):
    """A broadcast for model parameters, whose size does not depend on the corpus."""
    return spark.sparkContext.broadcast(value)


def bounded_sample(df: DataFrame, rows: int, seed: int, column: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those with the least seeded hash of the id: a documented bound for model fitting only."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(column).cast("string")), F.col(column)).limit(rows)


def labelled(spark: SparkSession, sf_dir: str, label: str, divisor: int) -> DataFrame:
    """(doc_id, label) of the rows outside the held-out fold; null labels and ids are left out, one row an id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(divisor) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
