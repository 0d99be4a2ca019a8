"""K1, K2, K5. Inverted word index of chunks: written once, searched by postings.

Below its path: ``postings`` has a row (word, chunk) per distinct word of a chunk, in folders
by the word's hash, so that a search opens the folders of its words; a folder of many chunks
has several files, so that no word passes through one task. ``terms`` has each word's number
of chunks and is a versioned table that is written last: a folder without it is no index.
``texts`` has the chunks with their scope (ticker, section, subsection) and length, in
folders by batch and document.

``search`` gives the rows that ``search.search_chunks`` gives, without reading all texts:
all key words are intersected from the rarest on; a phrase is looked for in the chunks that
hold its rarest whole word, the only texts that are fetched; any key word is a sum over
postings. A chunk is (doc_id, chunk_index); missing scope columns count as null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked
from tallyfold.operators.search import hit_score, in_scope
from tallyfold.sources.scratch import materialize
from tallyfold.sources.tables import read_newest, write_version

BUCKETS = 64
PART_CHUNKS = 2_000_000  # a bucket's postings of about so many chunks go through one task
CHUNK = ["doc_id", "chunk_index"]
SCOPE = {"ticker": "own_ticker", "section_type": "own_section", "subsection": "own_subsection"}


def word_list(col: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(col), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def bucket(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


class TextIndex:
    """An index that was written by ``build``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.terms = read_newest(spark, f"{self.path}/terms")
        self.buckets = self.terms.agg(F.max("buckets")).first()[0] or BUCKETS
        self.postings = spark.read.parquet(f"{self.path}/postings")
        texts = spark.read.parquet(f"{self.path}/texts")
        self.texts = texts.drop("chars", "batch", "bucket")
        self.chunks = texts.select(*CHUNK, "chars", *(F.col(c).alias(n) for c, n in SCOPE.items()))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
        path = path.rstrip("/")
        _write(chunks, path, buckets)
        _count(chunks.sparkSession, path, buckets)
        return cls(chunks.sparkSession, path)

    def add(self, chunks: DataFrame) -> None:
        """Chunks of documents that the index does not have."""
        _write(chunks, self.path, self.buckets)
        _count(self.spark, self.path, self.buckets)
        self.__init__(self.spark, self.path)

    def _of(self, words: DataFrame, keys: list[str]) -> DataFrame:
        """Postings of ``words`` (term and ``keys``): only the folders of these words are
        read. What comes to the driver is at most every bucket's number once."""
        words = words.withColumn("bucket", bucket(F.col("term"), self.buckets))
        wanted = [r[0] for r in words.select("bucket").distinct().collect()]
        return self.postings.filter(F.col("bucket").isin(wanted)).join(words.select("bucket", "term", *keys), ["bucket", "term"]).drop("bucket")

    def _rarest(self, words: DataFrame) -> DataFrame:
        """Of each query's words (query_id, term) the one of fewest chunks, if it has any."""
        counted = words.distinct().join(self.terms.select("term", "n"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return ranked(counted, ["query_id"], "n", "term").select("query_id", "term", "n")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """K1. (query_id, doc_id, chunk_index, stage, score): see ``search.search_chunks``."""
        has = lambda c: F.col(c) if c in queries.columns else F.lit(None).cast("string")
        asked = materialize(queries.select("query_id", "phrase", "terms", *(has(c).alias(c) for c in ("section", "subsection", "suggested", "ticker"))), "asked")
        entries = asked.select("query_id", F.explode("terms").alias("term"))
        wanted = asked.select("query_id", "section", "subsection", "ticker", F.size("terms").alias("n"))
        here = in_scope("ticker", "own_ticker") & in_scope("section", "own_section") & in_scope("subsection", "own_subsection")

        # chunks that hold the rarest key word, and those that may hold the phrase
        seeds = self._rarest(entries).filter("n > 0").select("query_id", "term", F.lit(False).alias("said"))
        long = asked.filter(F.length("phrase") > 10)
        inner = F.array_compact(F.slice(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+"), 2, F.greatest(F.size(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+")) - 2, F.lit(0))))
        whole = long.select("query_id", F.explode(inner).alias("term")).filter("term <> ''")
        loose = long.join(whole.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode("terms").alias("term")).distinct()
        phrase = self._rarest(whole).select("query_id", "term").unionByName(loose).withColumn("said", F.lit(True))
        found = self._of(seeds.unionByName(phrase), ["query_id", "said"]).join(self.chunks, CHUNK).join(wanted, "query_id").filter(here)
        found = materialize(found.groupBy("query_id", "n", *CHUNK, "chars").agg(F.max("said").alias("said")), "seeds")
        text = self.texts.select(*CHUNK, F.lower("content").alias("c")).join(found.filter("said").select(*CHUNK).distinct(), CHUNK)
        said = found.filter("said").select("query_id", *CHUNK).join(text, CHUNK).join(long.select("query_id", F.lower("phrase").alias("p")), "query_id").filter(F.col("c").contains(F.col("p"))).select("query_id", *CHUNK, F.lit(1).alias("phrase"))
        matched = self._of(entries.join(found.select("query_id").distinct(), "query_id", "left_semi"), ["query_id"]).join(found, ["query_id", *CHUNK]).groupBy("query_id", "n", *CHUNK, "chars").agg(F.count("*").alias("matched"))
        best = matched.join(said, ["query_id", *CHUNK], "left")
        best = best.withColumn("stage", F.when(F.col("phrase") == 1, 1).when(F.col("matched") == F.col("n"), 2)).filter("stage is not null")
        best = materialize(best.select("query_id", *CHUNK, "stage", "matched", "n", "chars"), "stage-1-2")

        # of the other queries any key word
        rest = entries.join(best.select("query_id").distinct(), "query_id", "left_anti")
        any_word = self._of(rest, ["query_id"]).groupBy("query_id", *CHUNK).agg(F.count("*").alias("matched")).join(self.chunks, CHUNK).join(wanted, "query_id").filter(in_scope("ticker", "own_ticker"))
        stage = F.when(here, 3).when(in_scope("section", "own_section"), 4).otherwise(5)
        any_word = materialize(any_word.select("query_id", *CHUNK, stage.alias("stage"), "matched", "n", "chars"), "stage-3-5")
        hits = best.unionByName(any_word)
        hits = hits.join(hits.groupBy("query_id").agg(F.min("stage").alias("stage")), ["query_id", "stage"])
        hits = ranked(hits.withColumn("score", hit_score("stage", "matched", "n", "chars")), ["query_id"], F.desc("score"), *CHUNK, top=k).select("query_id", *CHUNK, "stage", "score")
        hits = materialize(hits, "hits")
        nothing = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").filter("suggested is not null").select("query_id", "ticker", F.col("suggested").alias("own_section"))
        others = nothing.join(self.texts.select(*CHUNK, F.col("section_type").alias("own_section"), F.col("ticker").alias("own_ticker")), "own_section").filter(in_scope("ticker", "own_ticker"))
        others = ranked(others, ["query_id"], *CHUNK, top=k)
        return hits.unionByName(others.select("query_id", *CHUNK, F.lit(6).alias("stage"), F.lit(0.3).alias("score")))


def _write(chunks: DataFrame, path: str, buckets: int) -> None:
    """Texts first; the postings are made from what was written, so ``chunks`` is worked
    out once, and what holds for a chunk is written once and not with each of its words."""
    has = lambda c: F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string")
    batch = f"b{uuid.uuid4().hex}"
    texts = chunks.select(*CHUNK, *(has(c).alias(c) for c in SCOPE), "content", F.length(F.lower("content")).alias("chars"), F.lit(batch).alias("batch"), bucket(F.col("doc_id"), buckets).alias("bucket"))
    texts.repartition("bucket", F.pmod("chunk_index", F.lit(16))).write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/texts")
    written = chunks.sparkSession.read.schema(texts.schema).parquet(f"{path}/texts").filter(F.col("batch") == batch)
    parts = 1 + written.count() // PART_CHUNKS
    rows = written.select(*CHUNK, F.explode(word_list(F.col("content"))).alias("term")).withColumn("bucket", bucket(F.col("term"), buckets))
    place = F.col("bucket") + buckets * bucket(F.struct(*CHUNK), parts)
    rows.repartitionById(buckets * parts, place).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def _count(spark: SparkSession, path: str, buckets: int) -> None:
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("n"))
    write_version(terms.withColumn("buckets", F.lit(buckets)), f"{path}/terms")
