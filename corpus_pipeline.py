"""A training corpus in five stages: rate, drop near copies, decontaminate, redact, pack.

Each stage is written as Parquet under spark.checkpoint.dir and the next one reads that,
so a lost executor costs rereads of one stage at most.

Results on odd input, for every stage: a null text counts as the empty text, and stays
null in the rows that are kept; very long texts are read whole; where rows are dropped,
each row is decided by a number of its own, so rows that share a doc_id or have none are
kept or dropped by their texts alone; columns that documents does not have pass through,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, near_join, packing, pii, quality
from tallyfold.llm.common import materialize, table

FEW_IDS = 2_000_000  # rows that may be broadcast; beyond, the join shuffles


def new_column(docs: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a written number for each row, and that column's name."""
    row = new_column(docs, "row_number_")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``rows`` but those numbered in ``dropped``, without the number."""
    dropped = materialize(dropped.distinct(), "dropped")
    few = dropped.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(dropped) if few else dropped, row, "left_anti").select(*(c for c in rows.columns if c != row))


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least the threshold score; all of them without rows of both labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    if not model.learnt:
        return docs
    name = new_column(docs, "score")
    return quality.score(docs, model, name).filter(F.col(name) >= quality.CUT_SCORE).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, of equal ids any row."""
    rows, row = numbered(docs)
    groups = near_join.groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    groups = materialize(groups.join(rows.select(row, "doc_id"), row), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first, "first")  # a join of two tables: a group of very many copies may be split in it
    dropped = groups.join(first, "component_id").filter(F.col(row) != F.col(f"first.{row}")).select(row)
    return without(rows, row, dropped)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows, row = numbered(docs)
    found = decontaminate.find(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, row, found.select(F.col("doc_id").alias(row)))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data and secrets replaced."""
    return pii.redact(docs, pii.train(*pii.labelled_windows(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null text is one piece
    with the end id alone."""
    return packing.pack(packing.cut(docs))


STAGES = [
    ("quality classifier", rate),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # learnt models and tokenizers: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
