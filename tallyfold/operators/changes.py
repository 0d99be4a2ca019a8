"""Differences between filings and between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.text import jaccard


def align_sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """C19. Sections of two filings: added, removed, unchanged (same digest), modified."""
    x = a.select("section_type", F.col("content").alias("old"))
    y = b.select("section_type", F.col("content").alias("new"))
    j = x.join(y, "section_type", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.sha2("old", 256) == F.sha2("new", 256), "unchanged").otherwise("modified")
    return j.select("section_type", kind.alias("change"), F.when(kind == "modified", F.round(jaccard(F.col("old"), F.col("new")), 6)).alias("similarity"))


def term_delta(a, b, stop: Sequence[str], first: int = 50, top: int = 10):
    """G5. Terms of more than four letters among the first fifty distinct: new ones and
    lost ones, ten of each."""
    terms = lambda c: F.slice(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: (F.length(w) > 4) & ~w.isin(list(stop)))), 1, first)
    return F.struct(F.array_join(F.slice(F.array_except(terms(b), terms(a)), 1, top), ",").alias("added"), F.array_join(F.slice(F.array_except(terms(a), terms(b)), 1, top), ",").alias("removed"))


def metric_changes(facts: DataFrame, before: str, after: str, least: float = 20.0, high: float = 50.0) -> DataFrame:
    """Q1. Metrics that went, came, or moved by more than ``least`` per cent."""
    side = lambda p, n: facts.filter(F.col("fiscal_period") == p).groupBy("ticker", "metric").agg(F.max("value").alias(n))
    j = side(before, "old").join(side(after, "new"), ["ticker", "metric"], "full")
    pct = F.round((F.col("new") - F.col("old")) / F.nullif(F.abs("old"), F.lit(0.0)) * 100, 4)
    j = j.withColumn("pct", pct)
    kind = F.when(F.col("new").isNull(), "discontinued").when(F.col("old").isNull(), "new").when(F.abs("pct") > least, "changed")
    weight = F.when(kind == "discontinued", "high").when(kind == "new", "medium").when(F.abs("pct") > high, "high").otherwise("medium")
    return j.withColumn("change", kind).filter("change is not null").select("ticker", "metric", "change", "pct", weight.alias("materiality"))


def new_sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q2. Sections only the later side has, with a sample of their first chunk."""
    only = b.join(a.select("ticker", "section_type").distinct(), ["ticker", "section_type"], "left_anti")
    return only.groupBy("ticker", "section_type").agg(F.substring(F.min_by("content", F.struct("filing_date", "doc_id", "chunk_index")), 1, 200).alias("sample"), F.count("*").alias("n"))


def keyword_changes(a: DataFrame, b: DataFrame, words: Sequence[str], least: float = 50.0) -> DataFrame:
    """Q4. Tracked words whose frequency moved by more than ``least`` per cent."""
    n = lambda df, s: df.groupBy("ticker").agg(*(F.sum(F.regexp_count(F.lower("content"), F.lit(rf"\b{w}\b"))).alias(f"{w}_{s}") for w in words))
    j = n(a, "a").join(n(b, "b"), "ticker")
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"{w}_a").alias("old"), F.col(f"{w}_b").alias("new")) for w in words))
    r = j.select("ticker", F.inline(rows)).filter("old > 0").withColumn("pct", F.round((F.col("new") - F.col("old")) / F.col("old") * 100, 4))
    return r.filter(F.abs("pct") > least).withColumn("materiality", F.when(F.abs("pct") > 100, "medium").otherwise("low"))


def risk_focus(a: DataFrame, b: DataFrame, words: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Q3. Key words that more chunks mention than before, where the chunks grew."""
    n = lambda df, s: df.groupBy("ticker").agg(F.count("*").alias(f"n_{s}"), *(F.count_if(F.lower("content").contains(w)).alias(f"{w}_{s}") for w in words))
    j = n(a, "a").join(n(b, "b"), "ticker").filter("n_b > n_a")
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"{w}_a").alias("old"), F.col(f"{w}_b").alias("new")) for w in words))
    return j.select("ticker", F.inline(rows)).filter(F.col("new") > factor * F.col("old"))


def tone_class_shift(a: DataFrame, b: DataFrame, positive: Sequence[str], negative: Sequence[str], rule: float = 1.2) -> DataFrame:
    """Q5. Tone class (word presence per chunk) of each side, where it changed."""

    def side(df: DataFrame, name: str) -> DataFrame:
        has = lambda ws: sum((F.sum(F.lower("content").contains(w).cast("int")) for w in ws), F.lit(0))
        g = df.groupBy("ticker").agg(has(positive).alias("p"), has(negative).alias("n"))
        return g.select("ticker", F.when(F.col("p") > rule * F.col("n"), "positive").when(F.col("n") > rule * F.col("p"), "negative").otherwise("neutral").alias(name))

    return side(a, "old").join(side(b, "new"), "ticker").filter("old <> new")


def accounting_mentions(chunks: DataFrame, words: Sequence[str]) -> DataFrame:
    """Q6. First of the key words each chunk mentions, with its surroundings."""
    t = F.lower("content")
    word = F.coalesce(*(F.when(t.contains(w), F.lit(w)) for w in words))
    rows = chunks.withColumn("word", word).filter("word is not null").withColumn("at", F.instr(t, F.col("word")))
    start = F.greatest(F.col("at") - 100, F.lit(1))
    return rows.select("doc_id", "chunk_index", "word", F.substring("content", start, F.col("at") - start + 200).alias("context"))


def change_summary(changes: DataFrame) -> DataFrame:
    """Q7. Counts by change, by materiality and in all."""
    return changes.groupingSets([["change"], ["materiality"], []], "change", "materiality").agg(F.count("*").alias("n"))
