"""Retrieval of chunks: key words, vectors, merging of hits, token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked
from tallyfold.operators.text import token_estimate
from tallyfold.operators.vector_blocks import QUERY_BLOCK, nearest
from tallyfold.sources.scratch import materialize


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, limit: int = QUERY_BLOCK) -> DataFrame:
    """F3. Exact cosine top k per query. The floor applies after the limit. Vectors are
    dealt in parts and queries in blocks of about ``limit``; a task multiplies one of each
    and hands on the best k."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    out = nearest(q, vectors.select("id", "v"), k, limit=limit)
    return out if floor is None else out.filter(F.col("score") >= floor)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """K3. Top k among the vectors of the wanted section and subsection; for queries that
    find none the subsection is dropped, then the section. ``queries`` and ``vectors``:
    (id, v, section, subsection). ``stage`` 1 to 3 tells what was kept."""
    left, out = queries, None
    for stage, keys in enumerate((["section", "subsection"], ["section"], []), 1):
        hits = nearest(left.select(F.col("id").alias("query_id"), F.col("v").alias("q"), *keys), vectors.select("id", "v", *keys), k, keys).select("query_id", "id", "score", "rank")
        hits = materialize(hits.withColumn("stage", F.lit(stage)), "hits")
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    return out


def semantic_match(queries: DataFrame, index: DataFrame, k: int, floor: float) -> DataFrame:
    """F4. Best vector of each metric among the 3k nearest above the floor, then top k."""
    near = vector_top_k(queries, index.select("id", "v"), 3 * k, floor).join(index.select("id", "metric"), "id")
    best = ranked(near, ["query_id", "metric"], F.desc("score"), "id")
    return ranked(best, ["query_id"], F.desc("score"), "metric", top=k).select("query_id", "metric", "score")


def merge_hits(user: DataFrame, filings: DataFrame, k: int, boost: float = 0.1) -> DataFrame:
    """G1. Two hit lists as one, filings a little ahead; best k per query."""
    both = user.select("query_id", "id", "score", F.lit("user").alias("origin")).unionByName(filings.select("query_id", "id", F.round(F.col("score") + boost, 6).alias("score"), F.lit("filing").alias("origin")))
    return ranked(both, ["query_id"], F.desc("score"), "origin", "id", top=k)


def boost_fold(hits, factor: float = 1.1):
    """P6. Folds scores in order: seen again, the larger of both times ``factor``."""
    return F.aggregate(hits, F.lit(None).cast("double"), lambda acc, h: F.when(acc.isNull(), h["score"]).otherwise(F.greatest(acc, h["score"]) * factor))


def merge_subqueries(hits: DataFrame, k: int) -> DataFrame:
    """G2. The same chunk from several sub-queries becomes one, scores folded in priority
    order. A chunk's hits are as many as the sub-queries, a handful."""
    g = hits.groupBy("query_id", "id").agg(F.sort_array(F.collect_list(F.struct("priority", "score"))).alias("h"))
    merged = g.select("query_id", "id", F.round(boost_fold(F.col("h")), 6).alias("score"), F.size("h").alias("seen"))
    return ranked(merged, ["query_id"], F.desc("score"), "id", top=k)


def budget(hits: DataFrame, max_tokens: int) -> DataFrame:
    """E28. Best hits while the running token count fits."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(W.unboundedPreceding, 0)
    return hits.withColumn("tokens", token_estimate(F.col("content"))).withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= max_tokens)


def with_neighbours(hits: DataFrame, chunks: DataFrame, max_tokens: int) -> DataFrame:
    """C16. The chunks before and after each hit in the same filing and section, while
    the token budget allows: before first."""
    side = lambda d, n: chunks.select("doc_id", "section_type", (F.col("chunk_index") - d).alias("chunk_index"), F.col("content").alias(n))
    j = hits.join(side(-1, "before"), ["doc_id", "section_type", "chunk_index"], "left").join(side(1, "after"), ["doc_id", "section_type", "chunk_index"], "left")
    own = token_estimate(F.col("content"))
    b, a = F.coalesce(token_estimate(F.col("before")), F.lit(0)), F.coalesce(token_estimate(F.col("after")), F.lit(0))
    keep_b = own + b <= max_tokens
    keep_a = own + F.when(keep_b, b).otherwise(0) + a <= max_tokens
    return j.withColumn("before", F.when(keep_b, F.col("before"))).withColumn("after", F.when(keep_a, F.col("after")))


def in_scope(wanted: str, own: str) -> Column:
    """Whether a row is of the section (or the like) that is wanted, if one is."""
    return F.col(wanted).isNull() | F.col(wanted).eqNullSafe(F.col(own))


def hit_score(stage: str, matched: str, n: str, chars: str) -> Column:
    said, long = F.when(F.col(stage) == 1, 0.4).otherwise(0.0), F.when(F.col(chars) > 1000, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), F.lit(0.3) + said + 0.2 * F.col(matched) / F.col(n) + long), 6)


def search_chunks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """K1. Cascade: the phrase, all key words, any key word, each within the wanted section
    and subsection; then any key word in the section, then anywhere, then whatever the
    section that the query's words suggest has to offer. Of each query only the first
    stage that finds something.

    ``queries``: (query_id, phrase, terms) and, if wanted, section, subsection, ticker
    (only its chunks count) and suggested (the section its words suggest); chunks may have
    section_type, subsection and ticker. Chunks meet queries on a shared word, so the join
    is an equi-join; stages are then read off the matched terms. This reads all chunks;
    ``text_index.TextIndex`` gives the same rows from postings.
    """
    has = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    wanted = ("section", "subsection", "ticker")
    asked = queries.select("query_id", "phrase", "terms", *(has(queries, c).alias(c) for c in (*wanted, "suggested")))
    texts = chunks.select("doc_id", "chunk_index", "content", *(has(chunks, c).alias(n) for c, n in (("section_type", "own_section"), ("subsection", "own_subsection"), ("ticker", "own_ticker"))))
    t = asked.select("query_id", "phrase", *wanted, F.size("terms").alias("n"), F.explode("terms").alias("term"))
    w = texts.select("doc_id", "chunk_index", F.explode(F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"))).alias("term"))
    hits = w.join(t, "term").groupBy("query_id", "phrase", "n", *wanted, "doc_id", "chunk_index").agg(F.count("*").alias("matched"))
    hits = hits.join(texts.withColumn("c", F.lower("content")).drop("content"), ["doc_id", "chunk_index"]).filter(in_scope("ticker", "own_ticker"))
    in_section = in_scope("section", "own_section")
    in_both = in_section & in_scope("subsection", "own_subsection")
    phrase = (F.length("phrase") > 10) & F.col("c").contains(F.lower(F.col("phrase")))
    stage = F.when(in_both & phrase, 1).when(in_both & (F.col("matched") == F.col("n")), 2).when(in_both, 3).when(in_section, 4).otherwise(5)
    # without the texts: a query's hits may be nearly all chunks
    staged = hits.withColumn("stage", stage).withColumn("chars", F.length("c")).select("query_id", "doc_id", "chunk_index", "stage", "matched", "n", "chars")
    staged = materialize(staged, "staged")
    first = staged.groupBy("query_id").agg(F.min("stage").alias("stage"))
    staged = staged.join(first, ["query_id", "stage"])
    cols = ["query_id", "doc_id", "chunk_index", "stage", "score"]
    best = ranked(staged.withColumn("score", hit_score("stage", "matched", "n", "chars")), ["query_id"], F.desc("score"), "doc_id", "chunk_index", top=k).select(*cols)
    nothing = asked.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "ticker", F.col("suggested").alias("own_section"))
    rest = ranked(nothing.join(texts, "own_section").filter(in_scope("ticker", "own_ticker")), ["query_id"], "doc_id", "chunk_index", top=k)
    return best.unionByName(rest.select("query_id", "doc_id", "chunk_index", F.lit(6).alias("stage"), F.lit(0.3).alias("score")))


def needs_follow_up(hits: DataFrame, floor: float = 0.5, spread: float = 0.1) -> DataFrame:
    """K6. Too few hits, a low mean, or a wide spread."""
    g = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.var_pop("score").alias("var"))
    return g.select("query_id", "n", "mean", ((F.col("n") < 3) | (F.col("mean") < floor) | (F.col("var") > spread)).alias("follow_up"))


def new_hits(seen: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G8."""
    return found.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def dedupe_prefix(chunks: DataFrame, n: int = 100) -> DataFrame:
    """G6. First chunk of each opening, case and outer blanks aside."""
    return ranked(chunks, [F.lower(F.trim(F.substring("content", 1, n)))], "doc_id", "chunk_index")


def dedupe_hash(docs: DataFrame) -> DataFrame:
    """G7. Newest document of each content digest within a tenant."""
    return ranked(docs, ["tenant", F.sha2("text", 256)], F.desc("doc_id"))


def ann_top_k(queries: DataFrame, vectors: DataFrame, k: int, buckets: float = 0.5, tables: int = 12) -> DataFrame:
    """K7. Random-projection hashing finds candidates, exact cosine ranks them. A bucket as
    wide as recall takes holds a large share of the vectors, so candidates are not joined
    on buckets: a row brings its bucket of each table along, and rows and queries that
    share one are told apart and scored within a task."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=buckets, numHashTables=tables, seed=1)
    a, b = (df.select("id", "v", array_to_vector(F.col("v").cast("array<double>")).alias("f")) for df in (queries, vectors))
    model = lsh.fit(b)
    codes = F.transform("h", lambda x: F.hash(x.cast("string"))).alias("codes")
    near = model.transform(a).select(F.col("id").alias("query_id"), F.col("v").alias("q"), codes)
    return nearest(near, model.transform(b).select("id", "v", codes), k).select("query_id", "id", "score")


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """C29. ``[n]`` markers in first-seen order to the n-th hit."""
    n = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))
    marks = answers.select("query_id", F.posexplode(n).alias("position", "rank"))
    return marks.join(hits, ["query_id", "rank"]).select("query_id", "position", "rank", "id")


def retrieval_complete(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """C32. Queries all of whose tickers have a fact."""
    want = requests.select("query_id", F.explode("tickers").alias("ticker")).distinct()
    miss = want.join(facts.select("ticker").distinct(), "ticker", "left_anti").groupBy("query_id").agg(F.count("*").alias("missing"))
    return requests.select("query_id").join(miss, "query_id", "left").select("query_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("complete"))
