"""Intermediate tables of multi-step jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir, which the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # only on one machine is a local folder seen by every task
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so a
    lost executor costs a reread and not a recomputation."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
