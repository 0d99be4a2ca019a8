"""Fact tables: filters, summaries, and which record of several to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions.period import period_key, valid_period


def ranked(df: DataFrame, keys: Sequence[str | Column], *order: Column | str, top: int = 1) -> DataFrame:
    """The first ``top`` rows per key. Spark prunes such filters before the shuffle
    (window group limit), so hot keys cost each task ``top`` rows."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


first_per = ranked  # E1


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table that every task gets whole: more than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of at most {most} rows is expected here")
    return F.broadcast(df)


def query_facts(facts: DataFrame, ticker: str | None = None, metric: str | None = None, form: str | None = None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """B1. Any of the filters; newest filing first, then metric."""
    for col, op, value in (("ticker", "=", ticker), ("metric", "=", metric), ("filing_type", "=", form), ("filing_date", ">=", start), ("filing_date", "<=", end)):
        if value is not None:
            c = F.col(col)
            v = F.lit(value) if op == "=" else F.lit(value).cast("date")
            facts = facts.filter(c == v if op == "=" else c >= v if op == ">=" else c <= v)
    return facts.orderBy(F.desc("filing_date"), "metric", "ticker", "fiscal_period", "filing_type").limit(limit)


def retrieve(facts: DataFrame, synonyms: DataFrame, wanted: DataFrame, tickers: Sequence[str] | None = None, forms: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """B2. Facts of the wanted metrics under any synonym, whatever the case.

    ``synonyms``: (canonical, name); ``wanted``: (name). Nothing resolved gives nothing.
    """
    names = synonyms.select("canonical", F.lower("name").alias("key"))
    canon = wanted.select(F.lower("name").alias("key")).join(names, "key").select("canonical").distinct()
    keys = names.join(canon, "canonical", "left_semi").select("key").distinct()
    if tickers is not None:
        facts = facts.filter(F.lower("ticker").isin([t.lower() for t in tickers]))
    if forms is not None:
        facts = facts.filter(F.col("filing_type").isin(list(forms)))
    found = facts.withColumn("key", F.lower("metric")).join(keys, "key", "left_semi").drop("key")
    return found.orderBy("ticker", "metric", F.desc("fiscal_period"), "filing_type").limit(limit)


def match_periods(facts: DataFrame, periods: Sequence[str]) -> DataFrame:
    """B4. Periods that contain any of the given ones, FY and case aside."""
    text = F.lower(F.regexp_replace("fiscal_period", "(?i)fy", ""))
    keys = [p.lower().replace("fy", "").strip() for p in periods]
    return facts.filter(F.greatest(F.lit(False), F.lit(False), *(text.contains(k) for k in keys)))


def quality_filter(facts: DataFrame, registry: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """B6. Kept: metrics of the registry; fully confident facts whose us-gaap label ends
    in an alias of the metric; else label and metric agree and confidence is >= 0.7."""
    known = registry.select(F.col("metric"), F.lit(True).alias("known")).distinct()
    tag = F.lower(F.regexp_replace("raw_label", "^us-gaap:", ""))
    by_alias = F.lit(False)
    for metric, names in aliases.items():
        by_alias = by_alias | ((F.col("metric") == metric) & tag.isin([n.lower() for n in names]))
    agrees = label_agrees(F.col("raw_label"), F.col("metric"))
    keep = F.col("known") | ((F.col("confidence") >= 1) & F.col("raw_label").startswith("us-gaap:") & by_alias) | ((F.col("confidence") >= 0.7) & agrees)
    return facts.join(known, "metric", "left").filter(keep).select(*facts.columns)


def label_agrees(label: Column, metric: Column) -> Column:
    """H14. Every word of more than two letters of the metric occurs in the label; a
    one-word metric is simply contained."""
    text = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    words = F.filter(F.split(F.lower(metric), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) > 1, F.forall(words, lambda w: F.instr(text, w) > 0)).otherwise(F.instr(text, F.regexp_replace(F.lower(metric), "[^a-z0-9]", "")) > 0)


def validate_results(facts: DataFrame, floor: float = 0.7) -> DataFrame:
    """B7. Drops facts without value, confidence or period; marks unaudited ones."""
    note = F.when((F.col("filing_type") == "8-K") & (F.col("statement_type") == "income_statement"), "unaudited")
    return facts.filter(F.col("value").isNotNull() & (F.col("confidence") >= floor) & (period_key(F.col("fiscal_period")) > 0)).withColumn("note", note)


def plausible_periods(facts: DataFrame) -> DataFrame:
    """B8."""
    return facts.filter(valid_period(F.col("fiscal_period")))


def chartable(facts: DataFrame) -> DataFrame:
    """B9. Filing facts with a strict annual or quarterly period."""
    sourced = ~F.coalesce(F.col("filing_type").isin("document", "computed", "contextual"), F.lit(False))
    return facts.filter(sourced & F.col("fiscal_period").rlike(r"^(FY\d{4}|Q[1-4] \d{4})$"))


def scope_facts(facts: DataFrame, start: str, end: str, metrics: Sequence[str]) -> DataFrame:
    """B13. Statement date within the window and an allowed metric."""
    return facts.filter(F.col("statement_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("metric").isin(list(metrics)))


def facts_by_concept(facts: DataFrame, text: str) -> DataFrame:
    """B16. Label contains the text."""
    return facts.filter(F.lower("raw_label").contains(text.lower()))


def summary(facts: DataFrame) -> DataFrame:
    """D1. Counts and sums by ticker, by metric and overall in one result."""
    amount = F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("total")
    return facts.groupingSets([["ticker"], ["metric"], []], "ticker", "metric").agg(F.count("*").alias("n"), amount)


def ticker_stats(facts: DataFrame) -> DataFrame:
    """D2."""
    return facts.groupBy("ticker").agg(F.count("*").alias("n"), F.max("filing_date").alias("latest_date"), F.max_by("filing_type", F.struct("filing_date", "filing_type")).alias("latest_form"))


def metric_stats(facts: DataFrame) -> DataFrame:
    """D3."""
    last = F.max_by(F.struct("value", "fiscal_period", "filing_date"), F.struct("filing_date", "fiscal_period", "ticker")).alias("last")
    return facts.groupBy("metric").agg(F.count("*").alias("n"), last).select("metric", "n", F.col("last.value").alias("latest_value"), F.col("last.fiscal_period").alias("latest_period"), F.col("last.filing_date").alias("latest_date"))


def periods(facts: DataFrame) -> DataFrame:
    """D4. Per ticker and year: whether there is an annual row, and its quarters."""
    key = period_key(F.col("fiscal_period"))
    p = facts.select("ticker", (key / 10000).cast("int").alias("year"), ((key % 10000) / 100).cast("int").alias("quarter")).distinct()
    return p.groupBy("ticker", "year").agg(F.bool_or(F.col("quarter") == 0).alias("annual"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("quarter") > 0, F.col("quarter").cast("string")))), ",").alias("quarters"))


def snapshot(facts: DataFrame) -> DataFrame:
    """E2. All facts of each ticker's newest filing date."""
    return facts.withColumn("_last", F.max("filing_date").over(W.partitionBy("ticker"))).filter("filing_date = _last").drop("_last")


def series(facts: DataFrame, n: int) -> DataFrame:
    """E3. The newest ``n`` points of each ticker, metric and form."""
    return ranked(facts, ["ticker", "metric", "filing_type"], F.desc(period_key(F.col("fiscal_period"))), F.desc("filing_date"), top=n)


def dedupe_best(facts: DataFrame) -> DataFrame:
    """E4. Per ticker, metric and period: label match, confidence, capitalised name,
    then value decide."""
    capital = F.col("metric").rlike("^[A-Z]")
    return ranked(facts, ["ticker", F.lower("metric"), "fiscal_period"], F.desc(label_agrees(F.col("raw_label"), F.col("metric"))), F.desc("confidence"), F.desc(capital), F.desc("value"), "filing_type")


def dedupe_confidence(facts: DataFrame) -> DataFrame:
    """E5."""
    return ranked(facts, ["ticker", "metric", "fiscal_period", "filing_type"], F.desc("confidence"), F.desc("filing_date"), F.desc("value"))


def dedupe_newest(facts: DataFrame) -> DataFrame:
    """E6. Newest filing of each metric and period of a ticker; no value counts as 0."""
    return ranked(facts, ["ticker", "metric", "fiscal_period"], F.desc("filing_date"), F.desc("value"), "filing_type").withColumn("value", F.coalesce("value", F.lit(0.0)))


def period_values(facts: DataFrame, form: str, headline: Sequence[str] = (), floor: float = 1e6) -> DataFrame:
    """E7. One usable value per ticker, metric and period of a form."""
    ok = (F.col("filing_type") == form) & (F.col("confidence") >= 0.8) & (F.abs("value") >= F.when(F.col("metric").isin(list(headline)), floor).otherwise(0.0))
    if form == "10-K":
        ok = ok & F.col("fiscal_period").startswith("FY")
    return ranked(facts.filter(ok), ["ticker", "metric", "fiscal_period"], F.desc("confidence"), F.desc(F.abs("value")))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """E8. Per tag and period: fewest dimensions, then shortest context id."""
    return ranked(facts, ["tag", "period"], F.size("dims"), F.length("context"), "context")


def latest_bundle(facts: DataFrame, metrics: Sequence[str], history: int = 5) -> DataFrame:
    """E9. Of each trend-worthy metric: up to ``history`` annual rows and the newest
    quarterly one."""
    some = facts.filter(F.col("metric").isin(list(metrics)))
    kept = F.when(F.col("filing_type") == "10-K", history).when(F.col("filing_type") == "10-Q", 1).otherwise(0)
    rank = F.row_number().over(W.partitionBy("ticker", "metric", "filing_type").orderBy(F.desc(period_key(F.col("fiscal_period"))), F.desc("confidence"), F.desc("value")))
    return some.withColumn("rank", rank).filter(F.col("rank") <= kept)


def with_fallback(facts: DataFrame, extracted: DataFrame) -> DataFrame:
    """E10. Document metrics where filings have none: newest by period end."""
    only = extracted.join(facts.select("ticker", "metric").distinct(), ["ticker", "metric"], "left_anti")
    best = ranked(only, ["ticker", "metric"], F.desc_nulls_last("period_end"), F.desc("created"), F.desc("value"))
    conf = F.when(F.col("verified"), 0.95).otherwise(0.75)
    return facts.select("ticker", "metric", "fiscal_period", "value", "confidence").unionByName(best.select("ticker", "metric", "fiscal_period", "value", conf.alias("confidence")))


def compare(facts: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """E11. The latest value of each metric side by side, one row per ticker."""
    last = ranked(facts.filter(F.col("metric").isin(list(metrics))), ["ticker", "metric"], F.desc("filing_date"), F.desc(period_key(F.col("fiscal_period"))), "filing_type")
    return last.groupBy("ticker").pivot("metric", list(metrics)).agg(F.first("value"))


def merge_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G3. Rows of ``a``, and those of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a.select(*keys).distinct(), list(keys), "left_anti"))


def audit_sets(extracted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G4. Per ticker: how many metrics are extra, missing and common, and the share."""
    both = extracted.select(*keys).distinct().withColumn("x", F.lit(1)).join(available.select(*keys).distinct().withColumn("y", F.lit(1)), list(keys), "full")
    n = both.groupBy("ticker").agg(F.count_if(F.col("y").isNull()).alias("extra"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"))
    return n.withColumn("share", F.round(F.col("common") / F.nullif(F.col("common") + F.col("missing"), F.lit(0)), 6))


def industry_of(rows: DataFrame, mapping: DataFrame, default: str = "other", key: str = "ticker") -> DataFrame:
    """H30. The industry of each row's ticker, whatever its case; ``default`` where the
    mapping (ticker, industry) has none."""
    m = mapping.select(F.lower("ticker").alias("_key"), "industry").groupBy("_key").agg(F.min("industry").alias("industry"))
    return rows.withColumn("_key", F.lower(F.col(key).cast("string"))).join(m, "_key", "left").drop("_key").withColumn("industry", F.coalesce("industry", F.lit(default)))


def parent_metric(metric: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """H30. The parent of the first rule (pattern, parent) that a metric's name matches,
    unless it is the parent itself."""
    out = F.lit(None).cast("string")
    for pattern, parent in reversed(rules):
        out = F.when(F.lower(metric).rlike(pattern) & (F.lower(metric) != parent), parent).otherwise(out)
    return out


def indent_of(metric: Column, parent: Column) -> Column:
    """H30. Totals stand at the margin, parts of a parent one step in."""
    return F.when(F.lower(metric).rlike("^total") | parent.isNull(), 0).otherwise(1)
