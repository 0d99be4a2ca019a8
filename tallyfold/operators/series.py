"""Time series of facts: trailing sums, growth, runs, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions.period import period_key
from tallyfold.operators.facts import ranked

KEY = ("ticker", "metric")


def keyed(facts: DataFrame, form: str | None = None) -> DataFrame:
    if form:
        facts = facts.filter(F.col("filing_type") == form)
    return facts.withColumn("key", period_key(F.col("fiscal_period"))).filter("key > 0")


def by_key(keys: Sequence[str] = KEY):
    return W.partitionBy(*keys).orderBy("key")


def ttm(facts: DataFrame, keys: Sequence[str] = KEY, whole: bool = True) -> DataFrame:
    """E12. Sum of the newest four quarters; none with fewer. ``whole=False`` (E13, LTM)
    keeps partial sums and flags them."""
    last = ranked(keyed(facts, "10-Q"), keys, F.desc("key"), top=4)
    conf = [F.min("confidence").alias("confidence")] if "confidence" in facts.columns else []
    out = last.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("value"), F.count("value").alias("quarters"), F.max_by("fiscal_period", "key").alias("last_quarter"), *conf)
    return out.filter("quarters = 4") if whole else out.withColumn("incomplete", F.col("quarters") < 4)


def ltm(facts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """E13."""
    return ttm(facts, keys, whole=False)


def rolling_ttm(facts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """E12 at every quarter: the sum over it and the three before."""
    w = by_key(keys).rowsBetween(-3, 0)
    q = keyed(facts, "10-Q").withColumn("n", F.count("value").over(w)).withColumn("ttm", F.sum(F.col("value").cast("decimal(20,2)")).over(w).cast("double"))
    return q.filter("n = 4").select(*keys, "fiscal_period", "ttm")


def chain_fold(points: Column) -> Column:
    """P6. Folds (end, value) pairs, newest first: a link is taken if its quarter ends
    80 to 110 days before the last one taken."""
    zero = F.struct(F.lit(None).cast("date").alias("end"), F.lit(0).alias("n"), F.lit(0).cast("decimal(30,2)").alias("total"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["n"] == 0) | ((acc["n"] < 4) & F.datediff(acc["end"], p["end"]).between(80, 110))
        taken = F.struct(p["end"].alias("end"), (acc["n"] + 1).alias("n"), (acc["total"] + p["value"]).cast("decimal(30,2)").alias("total"))
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(points, zero, step)


def ttm_chain(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """E14. Four quarters in a gap-constrained chain from the newest; null if shorter.
    Only the 16 newest quarters of a series can matter to the report and are gathered."""
    q = facts.filter("filing_type = '10-Q'")
    if as_of:
        q = q.filter(F.col("statement_date") <= F.lit(as_of).cast("date"))
    q = ranked(q, [*KEY, "statement_date"], F.desc("filing_date"), F.desc("value"))  # of a quarter told twice the newest filing
    q = ranked(q, KEY, F.desc("statement_date"), top=16)
    points = F.sort_array(F.collect_list(F.struct(F.col("statement_date").alias("end"), F.col("value").cast("decimal(20,2)").alias("value"))), asc=False)
    out = q.groupBy(*KEY).agg(chain_fold(points).alias("c"))
    return out.select(*KEY, F.col("c.n").alias("links"), F.when(F.col("c.n") == 4, F.col("c.total").cast("double")).alias("ttm"))


def pick_fy(spans: DataFrame) -> DataFrame:
    """E15. Newest span of 330 to 370 inclusive days per ticker and metric."""
    return ranked(spans.filter((F.datediff("end", "start") + 1).between(330, 370)), KEY, F.desc("end"))


def pick_quarters(spans: DataFrame) -> DataFrame:
    """E15. Per ticker, metric and end: spans of 80 to 100 inclusive days."""
    return ranked(spans.filter((F.datediff("end", "start") + 1).between(80, 100)), [*KEY, "end"], F.desc("start"))


def resolve_by_priority(facts: DataFrame, priorities: DataFrame) -> DataFrame:
    """E16. Per ticker, period and target: the value of the first tag in the list that
    has one, signed as told, and every tag that was tried on the way.

    ``priorities``: (target, metric, priority, sign).
    """
    p = facts.join(priorities, "metric").filter("value is not null")
    best = F.min_by(F.struct("metric", "value", "sign", "priority"), "priority").alias("b")
    got = p.groupBy("ticker", "fiscal_period", "filing_type", "target").agg(best)
    return got.select("ticker", "fiscal_period", "filing_type", "target", F.col("b.metric").alias("metric"), (F.col("b.value") * F.col("b.sign")).alias("value"), F.col("b.priority").alias("attempts"))


def yoy(facts: DataFrame, form: str = "10-K") -> DataFrame:
    """E17. Growth on the previous point over its absolute value; null at zero."""
    prev = F.lag("value").over(by_key())
    return keyed(facts, form).withColumn("previous", prev).withColumn("yoy", F.round(F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")), 6)).select(*KEY, "fiscal_period", "value", "previous", "yoy")


def avg_yoy(facts: DataFrame) -> DataFrame:
    """E17. Mean growth per ticker and metric."""
    return yoy(facts).groupBy(*KEY).agg(F.round(F.avg("yoy"), 5).alias("avg_yoy"), F.count("yoy").alias("n"))


def cagr(facts: DataFrame, years: int = 5) -> DataFrame:
    """E18. Compound growth between the first and last of the newest ``years + 1``
    annual points; needs two points and a positive first one."""
    last = ranked(keyed(facts, "10-K"), KEY, F.desc("key"), top=years + 1)
    ends = last.groupBy(*KEY).agg(F.min_by("value", "key").alias("first"), F.max_by("value", "key").alias("last"), ((F.max("key") - F.min("key")) / 10000).cast("int").alias("years"), F.count("*").alias("n"))
    ok = (F.col("n") >= 2) & (F.col("first") > 0) & (F.col("last") > 0)
    return ends.select(*KEY, "years", F.when(ok, F.round(F.pow(F.col("last") / F.col("first"), 1 / F.col("years")) - 1, 6)).alias("cagr"))


def margin_trend(facts: DataFrame) -> DataFrame:
    """E19. (newest - oldest) / count of the annual net margins, and its direction."""
    wide = keyed(facts, "10-K").groupBy("ticker", "key").pivot("metric", ["net_income", "revenue"]).agg(F.max("value"))
    m = wide.withColumn("m", F.try_divide("net_income", "revenue")).filter("m is not null")
    out = m.groupBy("ticker").agg(F.round((F.max_by("m", "key") - F.min_by("m", "key")) / F.count("*"), 6).alias("trend"), F.count("*").alias("n"))
    return out.withColumn("improving", F.col("trend") > 0)


def zscore_outliers(facts: DataFrame, form: str = "10-Q", limit: float = 2.0) -> DataFrame:
    """E20. Newest points further than ``limit`` population deviations from the mean of
    their series of at least four."""
    w = W.partitionBy(*KEY)
    s = keyed(facts, form).withColumn("n", F.count("value").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w)).withColumn("newest", F.max("key").over(w))
    s = s.filter("n >= 4 and sd > 0 and key = newest").withColumn("z", F.round((F.col("value") - F.col("mean")) / F.col("sd"), 4)).filter(F.abs("z") > limit)
    severity = F.when(F.abs("z") > 3, "high").when(F.abs("z") > 2.5, "medium").otherwise("low")
    return s.select(*KEY, "fiscal_period", "value", "z", severity.alias("severity"))


def range_check(new: DataFrame, history: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """E21. New values against the newest eight of their history."""
    h = ranked(keyed(history), KEY, F.desc("key"), F.desc("filing_date"), top=8)
    h = h.groupBy(*KEY).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    odd = (F.col("n") >= 3) & (((F.col("sd") > 0) & (F.abs(F.col("value") - F.col("mean")) > sigmas * F.col("sd"))) | ((F.col("sd") == 0) & (F.col("value") != F.col("mean"))))
    j = new.join(h, list(KEY), "left").withColumn("out_of_range", F.coalesce(odd, F.lit(False)))
    return j.select(*new.columns, "out_of_range", F.when(F.col("out_of_range"), 0.3).otherwise(F.col("confidence")).alias("checked_confidence"))


def steps(facts: DataFrame, form: str = "10-Q", band: float = 0.05) -> DataFrame:
    """Direction of each step: up beyond x(1 + band), down below x(1 - band), else flat."""
    w = by_key()
    prev = F.lag("value").over(w)
    s = keyed(facts, form).withColumn("prev", prev)
    d = F.when(F.col("value") > F.col("prev") * (1 + band), "up").when(F.col("value") < F.col("prev") * (1 - band), "down").when(F.col("prev").isNotNull(), "flat")
    return s.withColumn("direction", d)


def streaks(facts: DataFrame, least: int = 4, points: int = 5, skip_flat: bool = False) -> DataFrame:
    """E22. Runs of steps in one direction at the end of a series of quarters. Sorted
    newest first, the run ends at the first step of another direction."""
    w = W.partitionBy(*KEY).orderBy(F.desc("key"))
    s = steps(facts).withColumn("n", F.count("*").over(W.partitionBy(*KEY))).filter(F.col("direction").isNotNull() & (F.col("n") >= points))
    s = s.withColumn("newest", F.first("direction").over(w)).withColumn("breaks", F.sum(F.when(F.col("direction") != F.col("newest"), 1).otherwise(0)).over(w))
    run = s.filter("breaks = 0").groupBy(*KEY, F.col("newest").alias("direction")).agg(F.count("*").alias("run"), F.max_by("fiscal_period", "key").alias("fiscal_period"))
    run = run.filter(F.col("run") >= least)
    return run.filter("direction <> 'flat'") if skip_flat else run


def reversals(facts: DataFrame, form: str = "10-K", least: float = 0.05) -> DataFrame:
    """E23. Series whose last two changes have opposite signs and are both large."""
    w = by_key()
    s = keyed(facts, form).withColumn("p1", F.lag("value", 1).over(w)).withColumn("p2", F.lag("value", 2).over(w)).withColumn("newest", F.max("key").over(W.partitionBy(*KEY)))
    s = s.filter("key = newest").withColumn("change", F.try_divide(F.col("value") - F.col("p1"), F.abs("p1"))).withColumn("before", F.try_divide(F.col("p1") - F.col("p2"), F.abs("p2")))
    turned = (F.signum("change") * F.signum("before") < 0) & (F.abs("change") > least) & (F.abs("before") > least)
    return s.filter(turned).select(*KEY, "fiscal_period", F.round("before", 6).alias("before"), F.round("change", 6).alias("change"))


def chart_series(facts: DataFrame, metric: str, form: str = "10-K") -> DataFrame:
    """E33. Every period of the axis for every ticker, gaps null, with growth."""
    s = keyed(facts.filter(F.col("metric") == metric), form).select("ticker", "fiscal_period", "key", "value")
    axis, tickers = s.select("fiscal_period", "key").distinct(), s.select("ticker").distinct()
    grid = tickers.withColumn("one", F.lit(1)).join(axis.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("fiscal_period", "key")).alias("axis")), "one")
    grid = grid.select("ticker", F.inline("axis"))
    out = grid.join(s, ["ticker", "fiscal_period", "key"], "left")
    prev = F.lag("value").over(W.partitionBy("ticker").orderBy("key"))
    return out.withColumn("yoy", F.round(F.try_divide(F.col("value") - prev, F.abs(prev)), 6)).select("ticker", "fiscal_period", "value", "yoy")
