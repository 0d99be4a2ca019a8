"""A7-A12. Tables with keyed writes that touch only what changed.

Rows are dealt to hash buckets by the columns ``by``. A write reads the buckets that its
batch has rows for, and writes their new state as ``data/<version>/bucket=<n>``; then one
line set in ``log``, a single file, says which version holds each of these buckets now.
Readers take every bucket from the newest version in the log that has it, so a write
that fails before its log file is there changes nothing, and buckets without rows in the
batch keep their files. Writers are not to run at the same time; one that finds a newer
log than it read gives up before it commits.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfold.sources import tables
from tallyfold.sources.scratch import materialize

LOG = "version string, bucket int, filled boolean"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema("by string, buckets int, columns string").json(f"{self.path}/about").first()
        if about is None:
            raise ValueError(f"no keyed table at {path}")
        self.by, self.buckets, self.schema = about["by"].split(","), about["buckets"], StructType.fromDDL(about["columns"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, by: Sequence[str], buckets: int = 256) -> KeyedTable:
        """An empty table. ``by``: columns that every key has, so that all rows of a key, or
        of a document, are in one bucket."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        path = path.rstrip("/")
        spark.createDataFrame([(",".join(by), buckets, columns)], "by string, buckets int, columns string").coalesce(1).write.json(f"{path}/about")
        spark.createDataFrame([], LOG).write.json(f"{path}/log")
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def state(self) -> dict[int, str]:
        """The version of each bucket that holds rows; at most an entry a bucket."""
        log = self.spark.read.schema(LOG).json(f"{self.path}/log")
        newest = log.groupBy("bucket").agg(F.max(F.struct("version", "filled")).alias("v")).select("bucket", "v.*")
        return {r["bucket"]: r["version"] for r in newest.filter("filled").collect()}

    def version(self) -> str | None:
        return self.spark.read.schema(LOG).json(f"{self.path}/log").agg(F.max("version")).first()[0]

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        state = self.state()
        dirs = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(state.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``rows``, a batch that has the columns ``by``, to
        ``change(those buckets, rows)``; their numbers."""
        before = self.version()
        rows = materialize(rows, "batch")
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        new = change(self.read(touched), rows).select(*self.schema.names).withColumn("bucket", self._bucket())
        version = f"v{time.time_ns():020d}"
        new.repartition(min(len(touched), 2000), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        filled = {r[0] for r in self.spark.read.schema(StructType.fromDDL("bucket int")).option("basePath", f"{self.path}/data/{version}").parquet(f"{self.path}/data/{version}").select("bucket").distinct().collect()}
        if self.version() != before:
            raise RuntimeError(f"another write to {self.path} came between: nothing was changed")
        line = [(version, b, b in filled) for b in touched]
        self.spark.createDataFrame(line, LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return touched

    def upsert(self, batch: DataFrame, keys: Sequence[str], order: str = "_order") -> list[int]:
        """Rows of the batch replace those of the same key: see ``tables.upsert``."""
        self._within(keys)
        return self._write(batch, lambda old, new: tables.upsert(old, new, keys, order))

    def insert_ignore(self, batch: DataFrame, keys: Sequence[str]) -> list[int]:
        self._within(keys)
        return self._write(batch, lambda old, new: tables.insert_ignore(old, new, keys))

    def replace_documents(self, batch: DataFrame, documents: DataFrame) -> list[int]:
        """All rows of ``documents`` (the columns ``by``) go and the batch's of these come."""
        ids = documents.select(*self.by).distinct()
        return self._write(ids, lambda old, new: old.join(new, self.by, "left_anti").unionByName(batch.select(*self.schema.names).join(new, self.by, "left_semi").select(*self.schema.names)))

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows whose columns of ``keys`` (those of ``by`` among them) are in it."""
        self._within(keys.columns)
        return self._write(keys.distinct(), lambda old, new: old.join(new, keys.columns, "left_anti"))

    def _within(self, keys: Sequence[str]) -> None:
        if not set(self.by) <= set(keys):
            raise ValueError(f"the key {list(keys)} lacks columns of {self.by}, by which rows are dealt")
