"""Peer groups: expansion, ranks, percentiles, comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked
from tallyfold.sources.scratch import materialize

PART, MOST_TASKS = 2000, 2000
SENT, ROW, PACK = 32 << 20, 32, 100


def expand_peers(tickers: DataFrame, universes: DataFrame) -> DataFrame:
    """C6. (ticker) x (universe, member) -> every member of each ticker's universes."""
    own = universes.select("universe", F.col("member").alias("ticker"))
    return tickers.join(own, "ticker").join(universes, "universe").select("universe", "ticker", F.col("member").alias("peer"))


def rank_peers(values: DataFrame, group: Sequence[str] = ("universe",)) -> DataFrame:
    """E25. Competition rank by value, missing values ranked last as the group's size;
    mean, median, and each one's distance from the median in per cent."""
    w = W.partitionBy(*group)
    stats = values.groupBy(*group).agg(F.count("*").alias("peers"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))
    place = F.rank().over(w.orderBy(F.desc_nulls_last("value")))
    r = values.withColumn("place", place).join(stats, list(group))
    pct = F.round((F.col("value") - F.col("median")) / F.nullif(F.abs("median"), F.lit(0.0)) * 100, 6)
    return r.select(*group, "ticker", "value", F.when(F.col("value").isNull(), F.col("peers")).otherwise(F.col("place")).cast("long").alias("rank"), F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"), pct.alias("vs_median_pct"))


def percentile_rank(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """E26. Share of the group strictly below, in per cent; the outer quarters stand out."""
    w = W.partitionBy(*group)
    below = (F.rank().over(w.orderBy("value")) - 1) / F.count("*").over(w) * 100
    r = values.filter("value is not null").withColumn("percentile", F.round(below, 4))
    return r.withColumn("outlier", (F.col("percentile") >= 75) | (F.col("percentile") <= 25)).select(*group, "ticker", "value", "percentile", "outlier")


def distribution(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """D20. Count, mean, median and linear quartiles; nulls dropped."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = values.groupBy(*group).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), q.alias("q"))
    return d.select(*group, "n", F.round("mean", 6).alias("mean"), *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "median", "p75"))))


def comp_table(facts: DataFrame, metrics: Sequence[str], period: str, companies: Sequence[str] | None = None) -> DataFrame:
    """E27. Companies by metrics for one period, newest filing first; empty rows go."""
    f = facts.filter((F.col("fiscal_period") == period) & F.col("metric").isin(list(metrics)))
    if companies is not None:
        f = f.filter(F.col("ticker").isin(list(companies)))
    best = ranked(f, ["ticker", "metric"], F.desc("filing_date"), F.desc("value"))
    out = best.groupBy("ticker").pivot("metric", list(metrics)).agg(F.first("value"))
    return out.filter(F.coalesce(*(F.col(m) for m in metrics)).isNotNull())


def divergence(values: DataFrame, subject: str) -> DataFrame:
    """D28. Per metric and period the peer furthest from the subject."""
    mine = values.filter(F.col("ticker") == subject).select("metric", "fiscal_period", F.col("value").alias("subject_value"))
    j = values.filter(F.col("ticker") != subject).join(mine, ["metric", "fiscal_period"]).withColumn("gap", F.round(F.abs(F.col("value") - F.col("subject_value")), 2))
    return ranked(j, ["metric", "fiscal_period"], F.desc("gap"), "ticker").select("metric", "fiscal_period", F.col("ticker").alias("peer"), "subject_value", "value", "gap")


def fy_mismatch(year_ends: DataFrame, limit: int = 60) -> DataFrame:
    """C17. Pairs of tickers whose year ends lie more than ``limit`` days apart, round
    the year. Tickers are cut into ranges; days of the year find each other (366 values), and
    a ticker meets those of the same and later ranges. Tickers of up to ``SENT`` bytes are sent
    to all tasks in packs of ``PACK`` of a range and day, and only pairs of packs are shuffled.
    Beyond, every two ranges of about ``PART`` and a day are a key of their own, and both
    sides are shuffled once for each."""
    days = materialize(year_ends.filter("ticker is not null").select("ticker", F.dayofyear("year_end").alias("day")), "days")
    n, size, ends = days.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ticker") + ROW), F.lit(0)), F.count_distinct("day")).first()
    parts = max(1, -(-n // PART))
    tasks = max(1, min(MOST_TASKS, ends * parts * parts))
    d = days.select("day").distinct()
    gap = F.abs(F.col("day") - F.col("other"))
    far = d.withColumn("other", F.explode(F.sequence(F.lit(1), F.lit(366)))).withColumn("gap", F.least(gap, 365 - gap)).filter(F.col("gap") > limit)
    far = F.broadcast(far.join(d.select(F.col("day").alias("other")), "other"))
    ranges = parts if size > SENT else max(1, n // (PACK * max(1, ends)))
    ranged = days.repartitionByRange(ranges, "ticker").withColumn("p", F.spark_partition_id())
    if size <= SENT:
        cut = F.transform(F.sequence(F.lit(0), ((F.size("names") - 1) / PACK).cast("int")), lambda k: F.slice("names", k * PACK + 1, PACK))
        packs = ranged.groupBy("p", "day").agg(F.collect_list("ticker").alias("names")).select("p", "day", F.explode(cut).alias("names"))
        packs = materialize(packs.withColumn("id", F.monotonically_increasing_id()), "packs")
        met = packs.select("day", "p", F.col("id").alias("i")).join(far, "day").join(F.broadcast(packs.select(F.col("day").alias("other"), F.col("p").alias("q"), F.col("id").alias("j"))), "other")
        pairs = met.filter("p <= q").select("i", "j", "p", "q", "gap").repartition(tasks, "i", "j")
        for key, name in (("i", "a"), ("j", "b")):
            pairs = pairs.join(F.broadcast(packs.select(F.col("id").alias(key), F.col("names").alias(f"{name}s"))), key)
        pairs = pairs.select("p", "q", "gap", "bs", F.explode("as").alias("a")).select("p", "q", "gap", "a", F.explode("bs").alias("b"))
    else:
        ranged = materialize(ranged, "ranges")
        keys = ["other", "p", "q"]
        a = ranged.withColumnRenamed("ticker", "a").join(far, "day").withColumn("q", F.explode(F.sequence("p", F.lit(parts - 1))))
        b = ranged.select(F.col("ticker").alias("b"), F.col("day").alias("other"), F.col("p").alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), "q")))
        a, b = (x.repartition(tasks, *keys) for x in (a, b))
        pairs = a.join(b.hint("shuffle_hash"), keys)
    return pairs.filter("p < q or a < b").select("a", "b", "gap")
