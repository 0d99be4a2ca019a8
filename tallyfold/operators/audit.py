"""Completeness audits, ingest validation, failure records and anomaly reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import series
from tallyfold.operators.facts import ranked, small
from tallyfold.operators.ratios import apply_sign
from tallyfold.operators.resolve import map_tags
from tallyfold.operators.text import slug, tone_shift


def statement_completeness(extracted: DataFrame, available: DataFrame, expected: DataFrame) -> DataFrame:
    """D24. Per ticker and statement: share of the expected or available metrics that
    were extracted. ``expected``: (statement_type, metric), at most 10,000 rows, each
    expected of every ticker."""
    keys = ["ticker", "statement_type", "metric"]
    tickers = available.select("ticker").distinct()
    want = available.select(*keys).unionByName(tickers.withColumn("one", F.lit(1)).join(small(expected.withColumn("one", F.lit(1))), "one").select(*keys)).distinct()
    got = extracted.select(*keys).distinct().withColumn("hit", F.lit(1))
    g = want.join(got, keys, "left").groupBy("ticker", "statement_type").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return g.withColumn("completeness", F.round(F.col("found") / F.col("wanted"), 6))


def missing_metrics(extracted: DataFrame, available: DataFrame, n: int = 20) -> DataFrame:
    """D23. Metrics most tickers lack."""
    miss = available.select("ticker", "metric").distinct().join(extracted.select("ticker", "metric").distinct(), ["ticker", "metric"], "left_anti")
    return miss.groupBy("metric").agg(F.count("*").alias("tickers")).orderBy(F.desc("tickers"), "metric").limit(n)


def gap_report(completeness: DataFrame, industries: DataFrame) -> DataFrame:
    """D23. Completeness by industry: mean, least, most, and what to do."""
    g = completeness.join(industries, "ticker").groupBy("industry").agg(F.count("*").alias("n"), F.round(F.avg("completeness"), 6).alias("mean"), F.min("completeness").alias("least"), F.max("completeness").alias("most"))
    return g.withColumn("advice", F.when(F.col("mean") < 0.5, "extend mappings").when(F.col("mean") < 0.9, "review gaps").otherwise("none"))


NET_INCOME = ("net_income", "netincome", "net_earnings", "net_profit")


def validate_ingest(batch: DataFrame, history: DataFrame, mapping: DataFrame, conventions: dict[str, str], statements: DataFrame | None = None, tolerance: float = 1e6) -> DataFrame:
    """M11. Name by slug and mapping, sign by convention, range by history, net income
    against the same period's on another statement of ``statements`` (as C26, where given);
    a list of flags per row."""
    named = map_tags(batch.withColumn("metric", slug(F.col("metric"))), mapping)
    rule = F.lit("any")
    for metric, convention in conventions.items():
        rule = F.when(F.col("metric") == metric, convention).otherwise(rule)
    signed = named.withColumn("signed", apply_sign(F.col("value"), rule))
    checked = series.range_check(signed, history)
    parts = F.lit(False)
    if statements is not None:
        income = lambda c: F.lower(c).isin(*NET_INCOME)
        known = statements.filter(income("metric")).groupBy("ticker", "fiscal_period", F.col("statement_type").alias("other_type")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
        rows = checked.filter(income("metric")).select("ticker", "fiscal_period", "statement_type", "signed").distinct()
        apart = F.greatest(F.abs(F.col("signed") - F.col("least")), F.abs(F.col("signed") - F.col("most"))) > tolerance
        apart = rows.join(known, ["ticker", "fiscal_period"]).filter((F.col("statement_type") != F.col("other_type")) & apart).select("ticker", "fiscal_period", "statement_type", "signed").distinct().withColumn("apart", F.lit(True))
        checked = checked.join(apart, ["ticker", "fiscal_period", "statement_type", "signed"], "left")
        parts = F.coalesce("apart", F.lit(False)) & income("metric")
    flags = F.array_compact(F.array(F.when(F.col("map_confidence") < 0.9, "unmapped"), F.when(F.col("signed") != F.col("value"), "sign"), F.when(F.col("out_of_range"), "range"), F.when(parts, "reconcile")))
    return checked.select("ticker", "fiscal_period", "filing_type", "canonical", F.col("signed").alias("value"), F.array_join(flags, ",").alias("flags"), "checked_confidence")


def record_failures(checks: DataFrame, open_rows: DataFrame) -> DataFrame:
    """M13. Failed checks that have no open record yet, one per key."""
    keys = ["ticker", "fiscal_period", "filing_type", "check_name"]
    return checks.filter("status = 'failed'").select(*keys).distinct().join(open_rows.select(*keys), keys, "left_anti")


def anomalies(facts: DataFrame, chunks: DataFrame, words: Sequence[str], z: float = 2.0, run: int = 4, shift: int = 3) -> DataFrame:
    """M14, F1. Outliers, runs, reversals and shifts of tone (``metric`` is the word) as one
    list, the most severe first, then by kind. ``facts`` and ``chunks``: of any tickers."""
    cols = ["ticker", "metric", "fiscal_period"]
    a = series.zscore_outliers(facts, limit=z).select(*cols, F.lit("outlier").alias("kind"), "severity")
    b = series.streaks(facts, least=run).select(*cols, F.lit("streak").alias("kind"), F.when(F.col("run") > 6, "high").otherwise("medium").alias("severity"))
    c = series.reversals(facts).select(*cols, F.lit("reversal").alias("kind"), F.lit("medium").alias("severity"))
    d = tone_shift(chunks, words, shift).select("ticker", F.col("word").alias("metric"), F.lit(None).cast("string").alias("fiscal_period"), F.lit("tone_shift").alias("kind"), F.lit("low").alias("severity"))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return a.unionByName(b).unionByName(c).unionByName(d).orderBy(order, "kind", *cols)


def persistable(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """G9. Document metrics by canonical name and period, the first of each; names the
    registry lacks keep theirs and are flagged."""
    known = registry.select(F.lower("name").alias("key"), "canonical").dropDuplicates(["key"])
    j = metrics.withColumn("key", F.lower("metric")).join(known, "key", "left")
    j = j.withColumn("resolved", F.col("canonical").isNotNull()).withColumn("canonical", F.coalesce("canonical", "metric"))
    return ranked(j, ["doc_id", "canonical", "fiscal_period"], "position").select("doc_id", "canonical", "fiscal_period", "value", "resolved")


def enrich(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """C23. Period and dimensions of each fact's context; facts without one stay."""
    return facts.join(contexts.withColumnRenamed("id", "context_ref"), "context_ref", "left")


def link_footnotes(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """C24. ``(n)``, ``[n]`` and ``<sup>n</sup>`` in labels to the filing's notes."""
    n = F.array_distinct(F.regexp_extract_all("label", F.lit(r"(?:\(|\[|<sup>)(\d{1,2})(?:\)|\]|</sup>)"), F.lit(1)))
    refs = facts.select("filing", "label", F.explode(n).alias("n")).withColumn("note", F.col("n").cast("int")).drop("n")
    return refs.join(notes, ["filing", "note"])


def validate_entities(entities: DataFrame, companies: DataFrame) -> DataFrame:
    """C33. Tickers stand; names contained in a company's, or the other way, count 0.8;
    the rest goes. Candidates share a word, so the join is an equi-join."""
    exact = entities.join(companies.select(F.col("ticker").alias("found")), F.upper(F.col("entity")) == F.col("found")).select("query_id", F.col("found").alias("ticker"), "confidence")
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"[^a-z0-9]+")))
    a = entities.withColumn("w", words("entity")).filter("w <> ''")
    b = companies.withColumn("w", words("company")).filter("w <> ''")
    near = a.join(b, "w").filter(F.lower("company").contains(F.lower("entity")) | F.lower("entity").contains(F.lower("company")))
    both = exact.unionByName(near.select("query_id", "ticker", F.round(F.col("confidence") * 0.8, 6).alias("confidence")))
    return both.groupBy("query_id", "ticker").agg(F.max("confidence").alias("confidence"))


def hedging_trend(statements: DataFrame) -> DataFrame:
    """E30. Weak statements in the first and the last filing."""
    g = statements.groupBy("ticker", "filing_date").agg(F.count_if(F.col("strength") == "weak").alias("weak"))
    t = g.groupBy("ticker").agg(F.min_by("weak", "filing_date").alias("first"), F.max_by("weak", "filing_date").alias("last"))
    return t.withColumn("trend", F.when(F.col("last") > F.col("first") + 2, "more").when(F.col("last") < F.col("first") - 2, "less").otherwise("steady"))


def order_by_map(df: DataFrame, col: str, order: Sequence[str], *then: str) -> DataFrame:
    """F7. Sorted by a column's place in a list; values not in it come last."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(col))
    return df.withColumn("priority", F.when(place == 0, len(order) + 1).otherwise(place)).orderBy("priority", *then)


def call_cost(tokens_in, tokens_out, rate_in: float, rate_out: float):
    """H32. Cost of a call at rates per million tokens."""
    return F.round((tokens_in * rate_in + tokens_out * rate_out) / 1e6, 8)


def has_any_tag(df: DataFrame, col: str, tags: Sequence[str]) -> DataFrame:
    """B10."""
    return df.filter(F.arrays_overlap(col, F.array(*(F.lit(t) for t in tags))))
