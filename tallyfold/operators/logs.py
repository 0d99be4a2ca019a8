"""Usage logs, coverage and queue statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked

# fixed values: latency limits in the log's unit (seconds)
LIMITS = (5, 10, 30, 120)


def log_summary(log: DataFrame, start: str, end: str) -> DataFrame:
    """D5. Totals per tenant over [start, end)."""
    rows = log.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    methods = [F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("click", "purchase", "view")]
    return rows.groupBy("tenant").agg(F.count("*").alias("n"), *methods, F.count_if(~F.col("success")).alias("failures"), F.round(F.avg("latency"), 4).alias("avg_latency"), F.round(F.sum(F.coalesce("latency", F.lit(0.0)).cast("decimal(20,4)")), 4).cast("double").alias("total_latency"))


def log_rates(log: DataFrame, now: str) -> DataFrame:
    """D6. One pass over the last 7 days: day and week counts, failure rates, and cost
    projected to a month."""
    at = F.lit(now).cast("timestamp")
    day = F.col("ts") >= at - F.expr("INTERVAL 1 DAY")
    rows = log.filter((F.col("ts") >= at - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < at))
    cost = F.sum(F.coalesce("latency", F.lit(0.0)).cast("decimal(20,4)"))
    return rows.groupBy("tenant").agg(
        F.count_if(day).alias("n_day"), F.count("*").alias("n_week"), F.round(F.try_divide(F.count_if(~F.col("success") & day), F.count_if(day)), 6).alias("failure_day"),
        F.round(F.try_divide(F.count_if(~F.col("success")), F.count("*")), 6).alias("failure_week"), F.round(cost.cast("double") / 7 * 30, 4).alias("monthly_cost"),
    )


def top_failures(log: DataFrame, n: int = 10) -> DataFrame:
    """D7. Most frequent failing queries: failed, or of low confidence."""
    bad = log.filter(~F.col("success") | (F.coalesce("confidence", F.lit(1.0)) <= 0.6))
    return bad.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def failure_patterns(log: DataFrame, pattern: Column, examples: int = 10) -> DataFrame:
    """D8. Failures by normalised pattern, with the first few examples. Distinct texts
    are numbered before they are gathered, so a common pattern gathers ``examples``."""
    bad = log.filter(~F.col("success")).withColumn("pattern", pattern)
    n = bad.groupBy("pattern").agg(F.count("*").alias("n"))
    few = ranked(bad.select("pattern", "query").distinct(), ["pattern"], "query", top=examples)
    return n.join(few.groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list("query")), "|").alias("examples")), "pattern", "left")


def top_requested(log: DataFrame, least: int = 2, n: int = 20) -> DataFrame:
    """D9. Requests by name: total, last time and who asked; at least ``least`` in all."""
    g = log.groupBy("query").agg(F.sum("weight").alias("requests"), F.max("ts").alias("last"), F.array_join(F.sort_array(F.collect_set(F.col("tenant").cast("string"))), ",").alias("tenants"))
    return g.filter(F.col("requests") >= least).orderBy(F.desc("requests"), F.desc("last"), "query").limit(n)


def audit_stats(log: DataFrame, n: int = 10) -> DataFrame:
    """D11. Totals, distinct users and the most frequent actions, in long form."""
    total = log.agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.countDistinct("user_id").alias("users"))
    long = total.select(F.inline(F.array(*(F.struct(F.lit("total").alias("kind"), F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in ("total", "ok", "users")))))
    top = log.groupBy(F.col("method").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)
    return long.unionByName(top.select(F.lit("action").alias("kind"), "name", "n"))


def status_counts(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """D12, D14, D15. Counts of the named values side by side, and of all others."""
    return df.agg(*(F.count_if(F.col(col) == v).alias(v) for v in values), F.count_if(~F.coalesce(F.col(col).isin(list(values)), F.lit(False))).alias("other"), F.count("*").alias("total"))


def chat_stats(messages: DataFrame) -> DataFrame:
    """D17. Messages, sessions, tokens, and messages per session: plain, and weighted by
    message as the mean over messages of their session's count."""
    s = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    return s.agg(F.sum("n").alias("messages"), F.count("*").alias("sessions"), F.round(F.avg("n"), 6).alias("avg_messages"), F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n"), 6).alias("avg_messages_weighted"), F.sum("tokens").alias("tokens"))


def usage_stats(log: DataFrame, rates: dict[str, float]) -> DataFrame:
    """D18. Use by status with its weighted cost."""
    rate = F.lit(0.0)
    for k, v in rates.items():
        rate = F.when(F.col("method") == k, v).otherwise(rate)
    return log.groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum(rate), 4).alias("cost"))


def top_sessions(messages: DataFrame, n: int = 10) -> DataFrame:
    """D18. Sessions with most tokens."""
    return messages.groupBy("conv_id").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens")).orderBy(F.desc("tokens"), "conv_id").limit(n)


def queue_stats(**tables: DataFrame) -> DataFrame:
    """D19. Status counts of several tables in one."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("queue"), "status", "n")
        out = part if out is None else out.unionByName(part)
    return out


def latency_profile(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """D21. Nearest-rank percentiles, counts over the limits, and the verdict."""
    agg = [F.expr(f"percentile_disc({q / 100}) within group (order by latency)").alias(f"p{q}") for q in (50, 95, 99)]
    over = [F.count_if(F.col("latency") > x).alias(f"over_{x}") for x in LIMITS]
    out = log.groupBy(*keys).agg(F.count("latency").alias("n"), *agg, F.min("latency").alias("min"), F.max("latency").alias("max"), F.round(F.avg("latency"), 6).alias("avg"), *over)
    return out.withColumn("healthy", (F.col("n") < 10) | ((F.col("p95") <= 5) & (F.col("over_120") == 0) & (F.col("over_10") < 0.2 * F.col("n"))))


def resolution_metrics(log: DataFrame) -> DataFrame:
    """D22. Counters per method, and percentiles at index floor(n * p) of the sorted
    values: the position is found by a window, nothing is gathered."""
    w = W.partitionBy("method")
    r = log.filter("latency is not null").withColumn("rn", F.row_number().over(w.orderBy("latency")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("latency")))
    return r.groupBy("method").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"))


def recent(log: DataFrame, n: int = 1000) -> DataFrame:
    """E29. The newest ``n`` rows."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def latest_valid(df: DataFrame, key: str, now: str, ttl: str) -> DataFrame:
    """A20. The newest record of each key if it is younger than ``ttl``."""
    at = F.lit(now).cast("timestamp")
    last = ranked(df.filter(F.col("ts") <= at), [key], F.desc("ts"), F.desc("event_id"))
    return last.filter(F.col("ts") > at - F.expr(f"INTERVAL {ttl}"))


def headlines(df: DataFrame, limit: int) -> DataFrame:
    """A19. News items from JSON of several shapes: first of title/headline/name, link,
    ISO or epoch time; no title or link, no row; newest first."""
    j = lambda *names: F.coalesce(*(F.nullif(F.get_json_object("body", f"$.{n}"), F.lit("")) for n in names))
    when = j("publishedAt", "time", "datetime")
    ts = F.when(when.rlike(r"^\d+$"), F.timestamp_seconds(when.cast("long"))).otherwise(F.try_to_timestamp(when))
    return df.select(j("title", "headline", "name").alias("title"), j("link", "url").alias("link"), ts.alias("ts")).filter("title is not null and link is not null").orderBy(F.desc("ts"), "title").limit(limit)


def unexpired(df: DataFrame, now: str) -> DataFrame:
    """B11. Rows that expire later, or never."""
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def due_tickers(log: DataFrame, done: DataFrame, least: int = 3) -> DataFrame:
    """D37. Asked for often enough and not generated yet."""
    n = log.groupBy("ticker").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return n.filter(F.col("n") >= least).join(done.select("ticker"), "ticker", "left_anti")


def detection_summary(states: DataFrame, tracked: DataFrame) -> DataFrame:
    """D33. Tracked tickers by state: checked, failing, never checked; last check."""
    j = tracked.select("ticker").distinct().join(states, "ticker", "left")
    return j.agg(F.count("*").alias("tracked"), F.count_if(F.col("last_check").isNotNull()).alias("checked"), F.count_if(F.col("last_check").isNull()).alias("never"), F.count_if(F.col("failures") > 0).alias("failing"), F.max("last_check").alias("last_check"))


def stale(states: DataFrame, now: str, hours: int = 26) -> DataFrame:
    """O7. Whether the newest check is too old."""
    last = states.agg(F.max("last_check").alias("last_check"))
    return last.withColumn("stale", F.coalesce(F.col("last_check") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True)))


def hit_summary(hits: DataFrame) -> DataFrame:
    """D30. Hits by section and ticker with mean score; the overall mean is weighted."""
    return hits.groupBy("section_type", "ticker").agg(F.count("*").alias("n"), F.round(F.sum("score") / F.count("score"), 6).alias("mean_score"))


def count_gaps(filings: DataFrame, chunks: DataFrame, least: int = 3) -> DataFrame:
    """D35. Declared against actual chunks per filing."""
    n = chunks.groupBy("filing").agg(F.count("*").alias("actual"))
    j = filings.join(n, "filing", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.select("filing", "declared", "actual", (F.col("declared") - F.col("actual")).alias("missing"), (F.col("actual") < least).alias("thin"))


def unsynced(chunks: DataFrame) -> DataFrame:
    """D36. Tickers with chunks that have no external id."""
    g = chunks.groupBy("ticker").agg(F.count("*").alias("total"), F.count("external_id").alias("synced"))
    return g.filter("total > synced").withColumn("missing", F.col("total") - F.col("synced")).withColumn("rate", F.round(F.col("synced") / F.col("total") * 100, 1))


def sync_status(source: DataFrame, exported: DataFrame) -> DataFrame:
    """C27. Counts per ticker in two stores, and whether they differ."""
    j = source.groupBy("ticker").agg(F.count("*").alias("n_source")).join(exported.groupBy("ticker").agg(F.count("*").alias("n_exported")), "ticker", "full")
    j = j.select("ticker", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_exported", F.lit(0)).alias("n_exported"))
    return j.withColumn("delta", F.col("n_source") - F.col("n_exported")).withColumn("needs_sync", F.col("delta") != 0)


def coverage(filings: DataFrame, insiders: DataFrame, holdings: DataFrame) -> DataFrame:
    """D13. Per ticker what several tables hold, and the newest date of any of them."""
    f = filings.groupBy("ticker").agg(F.count("*").alias("filings"), F.max("filing_date").alias("d1"), F.count_if(F.col("form") == "10-K").alias("annual"))
    i = insiders.groupBy("ticker").agg(F.count("*").alias("insiders"), F.max("transaction_date").alias("d2"))
    h = holdings.groupBy("ticker").agg(F.count("*").alias("holdings"), F.max("report_date").alias("d3"))
    j = f.join(i, "ticker", "full").join(h, "ticker", "full")
    return j.select("ticker", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("filings", "annual", "insiders", "holdings")), F.greatest("d1", "d2", "d3").alias("updated"))


def citation_stats(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """D16. Citations by source type: count, documents, mean score."""
    j = citations.join(docs, "doc_id")
    return j.groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"))


def deal_list(deals: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """C31, C8. Deals with their sessions and message counts, none left out. Messages
    are counted per session before the join."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    per = sessions.join(n, "conv_id", "left").groupBy("deal").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    return deals.join(per, "deal", "left").select("deal", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("messages", F.lit(0)).alias("messages"))


def vocabulary(facts: DataFrame, sample: int = 5) -> DataFrame:
    """D34. Per metric: occurrences, tickers, and the first few tickers; numbering
    before gathering keeps the sample of a common metric small."""
    n = facts.groupBy("metric").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))
    few = ranked(facts.select("metric", "ticker").distinct(), ["metric"], "ticker", top=sample)
    return n.join(few.groupBy("metric").agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("sample")), "metric")


def verify_totals(rows: DataFrame, controls: DataFrame, tolerance: float = 1000.0) -> DataFrame:
    """D27. Row counts and value sums against stated totals (in thousands); a missing
    total passes with a note."""
    got = rows.groupBy("accession").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(30,2)")).cast("double").alias("total"))
    j = got.join(controls, "accession", "left")
    count_ok = F.coalesce(F.col("n") == F.col("stated_n"), F.lit(True))
    sum_ok = F.coalesce(F.abs(F.col("total") - F.col("stated_thousands") * 1000) <= tolerance, F.lit(True))
    return j.select("accession", "n", "total", count_ok.alias("count_ok"), sum_ok.alias("sum_ok"), F.when(F.col("stated_n").isNull() | F.col("stated_thousands").isNull(), "no control total").alias("note"))
