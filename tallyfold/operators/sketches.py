"""Latency profiles that merge (D21, D22, O4).

A log is read once, into one row per key and five-minute window: exact counters and a
quantile sketch (KLL) of the latencies. Such rows, parts, are kept in files. Hours, days,
tenants or everything are merges of parts, in any order and grouping, and never read the
log again; late rows are further parts of their window.

Counts, sums, least and greatest values and the verdict are exact. A percentile is a
value whose rank is off by ``rank_error`` of the rows at most, with 99 % confidence;
twice that is practically never passed. A sketch takes a few kilobytes however many rows
it stands for, and is exact up to about ``k`` rows.

Null and NaN latencies count as rows only; infinite ones count and take part in
percentiles but not in the total; without latencies percentiles are null and the verdict
is healthy. Rows without a time have no window and are left out. Ties and repeated rows
count each. Empty logs give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.logs import LIMITS

K = 800
SHARES = (50, 95, 99)
ABOVE = 1e-6  # far below any sketch's error: "more than", where it asks for "at least"
COUNTS = ("rows", "n", "failures", *(f"over_{x}" for x in LIMITS))


def rank_error(k: int = K) -> float:
    """The published single-sided bound of a KLL sketch's ranks at 99 % confidence."""
    return 2.296 / k**0.9723


def windowed(log: DataFrame, keys: Sequence[str] = ("tenant", "method"), length: str = "5 minutes", k: int = K) -> DataFrame:
    """Parts of a log (ts, latency, success and ``keys``), one per key and window. Rows
    are combined before the shuffle, so a hot key sends one row per task and window."""
    log = log.filter("ts is not null").withColumn("latency", F.when(~F.isnan("latency"), F.col("latency")))
    x = F.col("latency")
    return (
        log.groupBy(*keys, F.window("ts", length).alias("w"))
        .agg(
            F.count("*").alias("rows"), F.count("latency").alias("n"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"), *(F.count_if(x > v).alias(f"over_{v}") for v in LIMITS),
            F.sum(x.try_cast("decimal(20,4)")).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), F.kll_sketch_agg_double("latency", k).alias("sketch"),
        )
        .select(*keys, F.col("w.start").alias("start"), *COUNTS, "total", "min", "max", "sketch")
    )


def rolled(parts: DataFrame, keys: Sequence[str] = (), unit: str | None = None, k: int = K) -> DataFrame:
    """Parts merged to ``keys`` and, with ``unit`` ("hour", "day", ...), to its starts."""
    at = [F.date_trunc(unit, "start").alias("start")] if unit else []
    return parts.groupBy(*keys, *at).agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.sum("total").cast("decimal(30,4)").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )


def quantile(share: float) -> Column:
    """The value at a share of a part's latencies, null without any."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))))


def profile(parts: DataFrame) -> DataFrame:
    """D21 of each part: percentiles from the sketch, all else exact. The verdict asks
    whether the 95th percentile is at most 5 seconds, which the count above 5 tells."""
    n = F.col("n")
    healthy = (n < 10) | ((n - F.col("over_5") >= F.ceil(n * F.lit(95) / 100)) & (F.col("over_120") == 0) & (F.col("over_10") < 0.2 * n))
    left = [c for c in parts.columns if c not in ("sketch", "total")]
    return parts.select(*left, F.round(F.col("total").cast("double") / F.nullif(n, F.lit(0)), 6).alias("avg"), *(quantile(q / 100).alias(f"p{q}") for q in SHARES), healthy.alias("healthy"))


def metrics(parts: DataFrame) -> DataFrame:
    """D22 of each part: percentiles at index floor(n * p), which is the first value with
    more than a share p of the rows up to it, and the share of successes."""
    left = [c for c in parts.columns if c not in ("sketch", "total", "min", "max")]
    return parts.select(*left, *(quantile(p + ABOVE).alias(f"p{round(p * 100)}") for p in (0.5, 0.99)), F.round(1 - F.col("failures") / F.col("rows"), 6).alias("success_rate"))


def checked(profiles: DataFrame, log: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Per profile, whether each percentile's true rank in the log is within twice
    ``rank_error``: an audit of stored parts. The log is counted once by its keys."""
    few = profiles.select(*keys, *(F.col(f"p{q}").alias(f"_{q}") for q in SHARES))
    x, near = F.col("latency"), 2 * rank_error(k)
    below = [f(F.when(c, 1)).alias(f"{name}_{q}") for q in SHARES for name, f, c in (("lt", F.count, x < F.col(f"_{q}")), ("le", F.count, x <= F.col(f"_{q}")))]
    met = log.filter("latency is not null and not isnan(latency)").join(few, list(keys)).groupBy(*keys).agg(F.count("*").alias("m"), *below)
    ok = [((F.col(f"lt_{q}") / F.col("m") - near <= q / 100) & (F.col(f"le_{q}") / F.col("m") + near >= q / 100)).alias(f"p{q}_near") for q in SHARES]
    return profiles.join(met.select(*keys, *ok), list(keys), "left")


def store(parts: DataFrame, path: str, batch: int | str) -> None:
    """Keep a batch's parts below ``path``, by day. The same batch again replaces itself,
    so a job or stream may repeat one; large days are split over several files."""
    parts.withColumn("day", F.to_date("start")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Kept parts, of the days from ``since`` to before ``until``; other days' files are
    not opened."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if since:
        parts = parts.filter(F.col("day") >= F.lit(since).cast("date"))
    if until:
        parts = parts.filter(F.col("day") < F.lit(until).cast("date"))
    return parts.drop("day", "batch")


def compacted(parts: DataFrame, keys: Sequence[str], path: str, k: int = K) -> None:
    """The same windows in one part each, as the only batch of a new store."""
    store(rolled(parts, [*keys, "start"], k=k), path, "all")


def sketch_batch(path: str, keys: Sequence[str] = ("tenant", "method"), k: int = K) -> Callable[[DataFrame, int], None]:
    """O4. A ``foreachBatch`` function that keeps each micro-batch's parts. The stream
    holds no state and no row is too late."""

    def run(batch: DataFrame, number: int) -> None:
        store(windowed(batch, keys, k=k), path, number)

    return run
