"""Versioned tables on Parquet: manifests, merges, change feed, time travel.

A commit writes new immutable files and then one manifest, ``_manifest/NNNNNN.json``, created under a name that must
not exist; readers see a version only by its manifest.  A table is a set of partitions (one folder of files each);
a merge rewrites only the partitions that its change rows touch.  Change rows carry ``_change_type`` (insert,
update_preimage, update_postimage, delete).  An operation that changes nothing makes no version.  One writer at a
time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

WHOLE = "_all"


class DuplicateKeys(ValueError):
    """A merge source names a key more than once."""


class VersionedTable:
    """path: folder; schema: of the rows; key: columns that identify a row; partition: a column, or None."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], partition: str | None = None):
        self.spark, self.path, self.schema, self.key, self.partition = spark, path.rstrip("/"), schema, key, partition
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    # manifests

    def _manifest_path(self, version: int):
        return self._jpath(f"{self.path}/_manifest/{version:06d}.json")

    def version(self) -> int:
        """The last committed version; -1 for a table without any."""
        folder = self._jpath(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return -1
        return max((int(s.getPath().getName()[:6]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "operation": None, "partitions": {}, "changes": None, "metrics": {}, "properties": {}}
        stream = self._fs.open(self._manifest_path(version))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, operation: str, partitions: dict, changes: str | None, metrics: dict, properties: dict | None = None) -> int:
        version = self.version() + 1
        body = {"version": version, "operation": operation, "partitions": partitions, "changes": changes, "metrics": metrics, "properties": {**self.manifest().get("properties", {}), **(properties or {})}}
        pending = self._jpath(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(pending, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if self._fs.exists(self._manifest_path(version)) or not self._fs.rename(pending, self._manifest_path(version)):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def set_property(self, name: str, value) -> int:
        now = self.manifest()
        return self._commit("properties", now["partitions"], None, {}, {name: value})

    # reading

    def _read(self, paths: list[str], schema: StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(sorted({p for ps in self.manifest(version)["partitions"].values() for p in ps}))

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Change rows of the versions in (after, upto]."""
        upto = self.version() if upto is None else upto
        out = self._read([], self._change_schema())
        for v in range(after + 1, upto + 1):
            found = self.manifest(v)["changes"]
            if found:
                out = out.unionByName(self._read([found], StructType([*self.schema.fields, StructField("_change_type", StringType())])).withColumn("_commit_version", F.lit(v).cast("long")))
        return out

    def _change_schema(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_change_type", StringType()), StructField("_commit_version", LongType())])

    def history(self) -> DataFrame:
        rows = [(m["version"], m["operation"], json.dumps(m["metrics"], sort_keys=True), len(m["partitions"])) for m in map(self.manifest, range(self.version() + 1))]
        return self.spark.createDataFrame(rows, "version int, operation string, metrics string, n_partitions int")

    # writing

    def _slot(self) -> Column:
        return F.coalesce(F.col(self.partition).cast("string"), F.lit("_null")) if self.partition else F.lit(WHOLE)

    def _write_rows(self, rows: DataFrame, sort: list[str] | None = None) -> dict[str, list[str]]:
        """Write rows by partition; the partitions' folders."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        out = rows.select(*self.schema.fieldNames()).withColumn("_slot", self._slot())
        if self.partition:
            # a partition is dealt out by key, so that no task holds all of it; small pieces are put together again
            out = out.repartition("_slot", F.pmod(F.xxhash64(*self.key), F.lit(int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        if sort:
            out = out.sortWithinPartitions("_slot", *sort)
        out.write.partitionBy("_slot").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(folder)) if s.isDirectory()]
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n.partition("=")[2]): [f"{folder}/{n}"] for n in names if n.startswith("_slot=")}

    def append(self, rows: DataFrame) -> int | None:
        found = self._write_rows(rows)
        if not found:
            return None
        now = self.manifest()["partitions"]
        n = self._read([p for ps in found.values() for p in ps]).count()
        changes = self._write_changes(self._read([p for ps in found.values() for p in ps]).withColumn("_change_type", F.lit("insert")))
        return self._commit("append", {k: now.get(k, []) + found.get(k, []) for k in {**now, **found}}, changes, {"inserted": n})

    def overwrite(self, rows: DataFrame, sort: list[str] | None = None) -> int:
        found = self._write_rows(rows, sort)
        return self._commit("overwrite", found, None, {"rows": self._read([p for ps in found.values() for p in ps]).count()})

    def _write_changes(self, rows: DataFrame) -> str:
        path = f"{self.path}/changes/{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames(), "_change_type").write.parquet(path)
        return path

    def _on(self, a: DataFrame, b: DataFrame) -> Column:
        on = F.lit(True)
        for k in self.key:
            on &= a[k] == b[k]
        return on

    def _apply(self, operation: str, changes: DataFrame) -> int | None:
        """Commit change rows: rewrite the partitions they touch."""
        path = self._write_changes(changes)
        done = self._read([path], StructType([*self.schema.fields, StructField("_change_type", StringType())]))
        counts = {r[0]: r[1] for r in done.groupBy("_change_type").count().collect()}
        if not counts:
            return None
        slots = [r[0] for r in done.select(self._slot().alias("s")).distinct().collect()]  # partitions touched, not rows
        now = self.manifest()["partitions"]
        old = self._read(sorted({p for s in slots for p in now.get(s, [])}))
        gone = done.where(F.col("_change_type").isin("update_preimage", "delete"))
        kept = old.join(gone.select(*self.key).distinct(), self.key, "left_anti")
        new = kept.unionByName(done.where(F.col("_change_type").isin("insert", "update_postimage")).drop("_change_type"))
        written = self._write_rows(new)
        partitions = {**{k: v for k, v in now.items() if k not in slots}, **written}
        return self._commit(operation, partitions, path, {"inserted": counts.get("insert", 0), "updated": counts.get("update_postimage", 0), "deleted": counts.get("delete", 0), "partitions_rewritten": len(slots)})

    def _unique(self, source: DataFrame) -> None:
        if not source.groupBy(*self.key).count().where("count > 1").isEmpty():
            raise DuplicateKeys(f"source has a key more than once: {self.key}")

    def insert_missing(self, source: DataFrame) -> int | None:
        """Insert the source rows whose key the table lacks."""
        now = self.read()
        fresh = source.alias("s").join(now.select(*self.key), self.key, "left_anti").select(*self.schema.fieldNames())
        return self._apply("insert_missing", fresh.withColumn("_change_type", F.lit("insert")))

    def update_where(self, source: DataFrame, changes: Callable[[DataFrame, DataFrame], dict[str, Column]], condition: Callable[[DataFrame, DataFrame], Column]) -> int | None:
        """Update the matched rows for which condition(target, source) holds."""
        self._unique(source)
        now = self.read()
        hit = now.join(source, self._on(now, source)).where(condition(now, source))
        new = changes(now, source)
        before = hit.select(*(now[c] for c in self.schema.fieldNames())).withColumn("_change_type", F.lit("update_preimage"))
        after = hit.select(*(new[c].alias(c) if c in new else now[c] for c in self.schema.fieldNames())).withColumn("_change_type", F.lit("update_postimage"))
        return self._apply("update_where", before.unionByName(after))

    def merge_full(self, source: DataFrame, delete_when: Column) -> int | None:
        """Delete matched rows where delete_when (over the source) holds, update other matched ones, insert the rest."""
        self._unique(source)
        now, names = self.read(), self.schema.fieldNames()
        marked = source.withColumn("_delete", F.coalesce(delete_when, F.lit(False)))
        hit = now.join(marked, self._on(now, marked))
        before = hit.select(*(now[c] for c in names), F.when(marked["_delete"], F.lit("delete")).otherwise(F.lit("update_preimage")).alias("_change_type"))
        after = hit.where(~marked["_delete"]).select(*(marked[c] for c in names)).withColumn("_change_type", F.lit("update_postimage"))
        fresh = marked.where(~F.col("_delete")).join(now.select(*self.key), self.key, "left_anti").select(*names).withColumn("_change_type", F.lit("insert"))
        return self._apply("merge_full", before.unionByName(after).unionByName(fresh))

    def delete_where(self, condition: Column) -> int | None:
        return self._apply("delete_where", self.read().where(condition).withColumn("_change_type", F.lit("delete")))
