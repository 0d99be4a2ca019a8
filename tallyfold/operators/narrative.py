"""Trends, drivers, guidance, severity and footnotes from narrative chunks."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallyfold.operators.facts import ranked
from tallyfold.operators.text import jaccard, occurrences, qualifiers, words_over
from tallyfold.sources.scratch import materialize


def trends(chunks: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """I8. "<metric> increased/decreased ... by N%": first mention of each metric."""
    pattern = rf"(?i)\b({'|'.join(metrics)})\s+(increased|decreased|grew|declined|rose|fell)(?:\s+by)?\s+(\d+(?:\.\d+)?)\s?(?:%|percent)"
    m = chunks.select("ticker", "doc_id", "chunk_index", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("pos", "hit"))
    part = lambda n: F.regexp_extract("hit", pattern, n)
    m = m.select("ticker", "doc_id", "chunk_index", "pos", F.lower(part(1)).alias("metric"), F.when(F.lower(part(2)).isin("increased", "grew", "rose"), "up").otherwise("down").alias("direction"), part(3).cast("double").alias("magnitude"))
    return ranked(m, ["ticker", "metric"], "doc_id", "chunk_index", "pos")


def drivers(col: Column) -> Column:
    """I9. What follows "due to" and its like, 10 to 200 characters, distinct."""
    found = F.regexp_extract_all(col, F.lit(r"(?i)(?:due to|driven by|as a result of|attributable to)\s+([^.;]{10,200})[.;]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def guidance(chunks: DataFrame, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """I11. First guidance sentence of a chunk and its tone, by the 1.5 rule."""
    # sentence by sentence: one pattern over the text goes back from each of its characters
    ended = F.split("content", r"\.", -1)
    told = F.filter(F.slice(ended, 1, F.size(ended) - 1), lambda t: t.rlike(r"(?i)\b(?:expect|anticipate|outlook|guidance|forecast)"))
    g = chunks.withColumn("guidance", F.trim(F.concat(F.try_element_at(told, F.lit(1)), F.lit(".")))).filter("guidance <> ''")
    p, n = occurrences(F.col("guidance"), positive), occurrences(F.col("guidance"), negative)
    return g.select("ticker", "doc_id", "chunk_index", "guidance", F.when(p > 1.5 * n, "positive").when(n > 1.5 * p, "negative").otherwise("neutral").alias("tone"))


def mda_confidence(n_trends: Column, n_risks: Column, guidance_text: Column) -> Column:
    """I12."""
    return F.least(F.lit(40), 10 * n_trends) + F.least(F.lit(30), 5 * n_risks) + F.when(F.length(guidance_text) > 20, 30).otherwise(0)


def severity(col: Column, red: Sequence[str], amber: Sequence[str]) -> Column:
    """I13."""
    t = F.lower(col)
    return F.when(t.rlike("|".join(red)), "RED_FLAG").when(t.rlike("|".join(amber)), "AMBER").otherwise("GREEN_CHALLENGE")


def footnotes(df: DataFrame) -> DataFrame:
    """I14. Type of a note by its words, and its list items."""
    t = F.lower("content")
    kind = F.when(t.contains("polic"), "policy").when(t.contains("segment"), "segment").when(t.contains("reconcil"), "reconciliation").otherwise("other")
    return df.select("id", kind.alias("kind"), F.size(F.regexp_extract_all("content", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("items"))


def latest_pair(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I15. Text of each section in the newest two filings, side by side."""
    d = sections.withColumn("k", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc("filing_date")))).filter("k <= 2")
    side = lambda k, n: ranked(d.filter(F.col("k") == k), keys, "doc_id").select(*keys, F.col("filing_date").alias(f"{n}_date"), F.col("content").alias(n))
    return side(1, "new").join(side(2, "old"), list(keys))


def concept_change(pairs: DataFrame, strong: Sequence[str], weak: Sequence[str], hedge: Sequence[str]) -> DataFrame:
    """I5. Low similarity or a shift of tone by two between old and new text."""
    q = lambda c: qualifiers(F.col(c), strong, weak, hedge)
    s = pairs.withColumn("similarity", F.round(jaccard(F.col("old"), F.col("new")), 6)).withColumn("tone", q("new") - q("old"))
    return s.withColumn("changed", (F.col("similarity") < 0.85) | (F.abs("tone") >= 2))


def greedy_matches(pairs: DataFrame, key: str) -> DataFrame:
    """Of (key, old, new, similarity) the matches that a pass over the old ones in their
    order makes, each taking the most similar new one that is left (of equals the first).

    In rounds: a pair is a match if the new one is the best left for the old one and no
    earlier old one has it among its own left ones; both then leave. Each round settles at
    least the first old one of every key, as a rule nearly all, by two aggregations and no
    group in one place.
    """
    left = materialize(pairs.select(key, "old", "new", "similarity"), "pairs")
    found = None
    while True:
        best = left.groupBy(key, "old").agg(F.max_by("new", F.struct("similarity", -F.col("new"))).alias("new"), F.max("similarity").alias("similarity"))
        first = left.groupBy(key, "new").agg(F.min("old").alias("old"))
        settled = materialize(best.join(first, [key, "old", "new"]).select(key, "old", "new", "similarity"), "settled")
        found = settled if found is None else materialize(found.unionByName(settled), "matches")
        left = left.join(settled.select(key, "old"), [key, "old"], "left_anti").join(settled.select(key, "new"), [key, "new"], "left_anti")
        left = materialize(left.select(key, "old", "new", "similarity"), "pairs")
        if left.isEmpty():
            return found


def greedy_pairs(old: Sequence[Sequence[str] | None], new: Sequence[Sequence[str] | None]) -> list[tuple[int, int | None, float]]:
    """C20 of one document: (old, new, similarity) of each old paragraph, given as distinct
    words (None: blank, no paragraph), in order. Equal word sets are compared once."""
    places: dict[frozenset, list[int]] = {}
    for j, words in enumerate(new):
        if words is not None:
            places.setdefault(frozenset(words), []).append(j)
    texts, queues = list(places), [deque(p) for p in places.values()]
    holders: dict[str, list[int]] = {}
    for t, words in enumerate(texts):
        for w in words:
            holders.setdefault(w, []).append(t)
    empty, near, out = [t for t, words in enumerate(texts) if not words], {}, []
    for i, words in enumerate(old):
        if words is None:
            continue
        words = frozenset(words)
        if words not in near:
            # more than 0.7 of the old one's words are in its match, so one of the first floor(0.3 n) + 1 is
            seeds = sorted(words, key=lambda w: (len(holders.get(w, ())), w))[: len(words) * 3 // 10 + 1]
            found = {}
            for t in {t for w in seeds for t in holders.get(w, ())}:
                shared = len(words & texts[t])
                union = len(words) + len(texts[t]) - shared
                found.setdefault((2_000_000 * shared + union) // (2 * union), []).append(t)
            near[words] = [(m, found[m]) for m in sorted(found, reverse=True) if m > 700_000] if words else [(1_000_000, empty)]
        best = None
        for m, at in near[words]:
            at[:] = [t for t in at if queues[t]]
            if at:
                best = queues[min(at, key=lambda t: queues[t][0])].popleft(), m / 1e6
                break
        out.append((i, *(best or (None, None))))
    return out


def diff_paragraphs(a: DataFrame, b: DataFrame, key: str, separator: str = r"\n\n+") -> DataFrame:
    """C20. Paragraphs of two versions matched greedily, in the order of the old ones, most
    similar first, each new one once: above 0.7 a match, below 0.95 modified. A document's
    two texts meet in one row, and are matched there; ``key`` tells documents apart."""

    def parts(name: str) -> Column:
        return F.transform(F.split(name, separator), lambda p: F.when(F.trim(p) != "", words_over(p))).alias(name)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(batch.num_rows):
                one = batch.slice(lo, 1)
                x, y = (one[c].to_pylist()[0] or [] for c in ("x", "y"))
                rows = greedy_pairs(x, y)
                taken = {j for _, j, _ in rows}
                rows += [(None, j, None) for j, words in enumerate(y) if words is not None and j not in taken]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([one[key].take(pa.array([0] * len(rows), pa.int32())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True))], names=[key, "old", "new", "similarity"])

    both = a.select(key, F.col("content").alias("x")).join(b.select(key, F.col("content").alias("y")), key, "full")
    both = both.select(key, parts("x"), parts("y"))
    j = both.mapInArrow(run, StructType([both.schema[key], StructField("old", IntegerType()), StructField("new", IntegerType()), StructField("similarity", DoubleType())]))
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("similarity") < 0.95, "modified").otherwise("unchanged")
    return j.select(key, "old", "new", kind.alias("change"), "similarity")


def embed_missing(chunks: DataFrame, embed) -> DataFrame:
    """K8, P4. Vectors for rows that have none, by the caller's function on batches of
    texts; a batch that fails is logged and stays without (null), to be counted and for
    the next run."""

    @F.pandas_udf("array<float>")
    def vector(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            try:
                yield pd.Series(list(embed(texts.tolist())))
            except Exception:  # the caller's function; the rows stay open
                logging.getLogger(__name__).exception("no vectors for %d texts", len(texts))
                yield pd.Series([None] * len(texts))

    todo = chunks.filter("v is null").withColumn("v", vector("content"))
    return chunks.filter("v is not null").unionByName(todo.select(*chunks.columns))
