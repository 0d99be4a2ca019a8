"""Sources and sinks: payloads to rows, files, and tables with keyed writes.

Keyed writes (upsert, insert-ignore, replace, drop) are DataFrames of the new state of a
table. ``write_version`` writes one as a new version beside the old ones and
``read_newest`` takes the newest that is whole, so a failed write leaves the last state.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked


def filings_from_submissions(payload: DataFrame) -> DataFrame:
    """A1. One row per index of the parallel arrays, null where one is short, with the
    archive address where accession and document are known."""
    rows = payload.select("cik", F.expr("inline_outer(arrays_zip(form, filingDate, accessionNumber, primaryDocument))"))
    path = F.concat(F.lit("/Archives/edgar/data/"), F.col("cik").cast("long"), F.lit("/"), F.regexp_replace("accessionNumber", "-", ""), F.lit("/"), F.col("primaryDocument"))
    return rows.withColumn("path", path)


def union_pages(*pages: DataFrame) -> DataFrame:
    """A2. Pages of one payload as one, missing columns null."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


FACT = "array<struct<end:string,val:double,form:string,filed:string>>"


def facts_from_companyfacts(payload: DataFrame, units: Sequence[str]) -> DataFrame:
    """A3. taxonomy -> tag -> unit -> facts flattened, units filtered whatever the case."""
    schema = f"map<string,map<string,struct<units:map<string,{FACT}>>>>"
    t = payload.select("cik", F.explode(F.from_json("facts", schema)).alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "body"))
    u = t.select("cik", "taxonomy", "tag", F.explode("body.units").alias("unit", "rows")).filter(F.upper("unit").isin([x.upper() for x in units]))
    return u.select("cik", "taxonomy", "tag", "unit", F.inline("rows"))


def backfill(rows: DataFrame, dim: DataFrame, keys: Sequence[str], col: str, default) -> DataFrame:
    """A22. A missing value from a dimension, else a default."""
    d = dim.select(*keys, F.col(col).alias("_d")).dropDuplicates(list(keys))
    return rows.join(d, list(keys), "left").withColumn(col, F.coalesce(col, "_d", F.lit(default))).drop("_d")


def metrics_from_extractions(rows: DataFrame) -> DataFrame:
    """A25. JSON extraction rows of type metric or headline with key and number."""
    j = F.from_json("data", "struct<type:string,metric_key:string,value:double,context:string,is_estimate:boolean,confidence:double>")
    r = rows.withColumn("j", j).filter(F.col("j.type").isin("metric", "headline") & F.col("j.metric_key").isNotNull() & F.col("j.value").isNotNull())
    return r.select("id", F.col("j.metric_key").alias("metric"), F.col("j.value").alias("value"), F.coalesce("j.context", F.lit("")).alias("context"), F.coalesce("j.is_estimate", F.lit(False)).alias("is_estimate"), F.coalesce("j.confidence", F.lit(0.8)).alias("confidence"))


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A23. All strings, trimmed, quotes by the usual CSV rules, first line the header."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A24. One row per file, with its name."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str = "_order") -> DataFrame:
    """A7-A10. Rows of the batch replace those of the same key; of several in one batch
    the last by ``order`` wins if it has that column, else the greatest."""
    rest = [c for c in batch.columns if c not in keys]
    if order in batch.columns:
        batch = ranked(batch, keys, F.desc(order)).drop(order)
    else:
        batch = ranked(batch, keys, *map(F.desc, rest)) if rest else batch.distinct()
    return target.join(batch.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A11. Only rows whose key is new are added; of several in one batch the least."""
    rest = [c for c in batch.columns if c not in keys]
    first = ranked(batch, keys, *rest) if rest else batch.distinct()
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def replace_documents(target: DataFrame, batch: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A12. All rows of the ``documents`` (one column, ``key``) go and those of the batch
    come, also for a document whose new set is empty. Rows of the batch of other documents
    are left out."""
    ids = documents.select(key).distinct()
    return target.join(ids, key, "left_anti").select(*target.columns).unionByName(batch.join(ids, key, "left_semi").select(*target.columns))


def write_version(df: DataFrame, path: str) -> str:
    """Writes ``df`` as the next version under ``path``, then a line in its log; its place."""
    version = f"v{time.time_ns():020d}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{path.rstrip('/')}/log")
    return f"{path.rstrip('/')}/{version}"


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version under ``path`` that the log has, so one written to its end."""
    last = spark.read.schema("version string").json(f"{path.rstrip('/')}/log").agg(F.max("version")).first()[0]
    if last is None:
        raise ValueError(f"no whole version under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{last}")


def write_lake(df: DataFrame, root: str, visibility: Column, source: str, stage: str) -> None:
    """A14. Rows under visibility / source / stage / ticker / filing type / period."""
    rows = df.withColumns({"visibility": visibility, "source": F.lit(source), "stage": F.lit(stage)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("visibility", "source", "stage", "ticker", "filing_type", "fiscal_period").parquet(root)


def drop_entity(tables: Sequence[DataFrame], ticker: str) -> list[DataFrame]:
    """A13. The tables without one ticker."""
    return [t.filter(~F.col("ticker").eqNullSafe(ticker)) for t in tables]


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """A12, A14. Writes the batch; only partitions it has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_sections(sections: DataFrame, path: str) -> None:
    """A15. One JSON record per section under ``text``, and one about it (sizes, digest,
    no text) under ``metadata``, both by ticker."""
    keyed = sections.withColumn("key", F.regexp_replace(F.concat_ws("_", F.col("ticker").cast("string"), "filing_type", "section_type", F.col("doc_id").cast("string")), "[^A-Za-z0-9_-]", "_"))
    keyed.write.mode("overwrite").partitionBy("ticker").json(f"{path}/text")
    about = keyed.select("ticker", "key", *(c for c in sections.columns if c not in ("ticker", "content")), F.length("content").alias("characters"), F.sha2("content", 256).alias("digest"))
    about.write.mode("overwrite").partitionBy("ticker").json(f"{path}/metadata")


def export_chunks(chunks: DataFrame, public: Sequence[str]) -> DataFrame:
    """A16. Chunks with a visibility tag and a page number of 5000 rows per ticker."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("ticker").orderBy("doc_id", "chunk_index"))
    return chunks.withColumn("visibility", F.when(F.col("filing_type").isin(list(public)), "public").otherwise("private")).withColumn("page", ((n - 1) / 5000).cast("int"))
