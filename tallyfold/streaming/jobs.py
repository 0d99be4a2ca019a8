"""Structured Streaming jobs: detection, notification, usage, sessions, ingest.

Late data: aggregates wait one day (``LATE``) behind the newest event time; ingest and
detection go by key, so late rows are upserts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.tables import upsert

LATE = "1 day"


def timed(src: DataFrame) -> DataFrame:
    """Event time with its watermark; a stream needs it as a timestamp with time zone."""
    if src.isStreaming:
        src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    return src.withWatermark("ts", LATE) if src.isStreaming else src


def stream_new_filings(src: DataFrame) -> DataFrame:
    """O1. Each accession once within the watermark. Stream columns: ticker, accession,
    ts."""
    return timed(src).dropDuplicatesWithinWatermark(["accession"])


def detection_state(state: DataFrame | None, batch: DataFrame, checked: str, failed: DataFrame | None = None) -> DataFrame:
    """O1. Per ticker: last check, last filing, filings seen, consecutive failures, after
    a micro-batch of (ticker, accession, ts) and the tickers whose check ``failed``. For
    ``foreachBatch``: the caller writes it as the next version of the state."""
    now = F.lit(checked).cast("timestamp")
    seen = batch.groupBy("ticker").agg(F.max("ts").cast("timestamp").alias("new_filing"), F.countDistinct("accession").alias("found"))
    fails = (failed if failed is not None else batch.limit(0)).select("ticker").distinct().withColumn("failed", F.lit(True))
    j = seen.join(fails, "ticker", "full")
    old = state if state is not None else batch.limit(0).select("ticker", now.alias("last_check"), now.alias("last_filing"), F.lit(0).cast("long").alias("filings"), F.lit(0).cast("long").alias("failures"))
    j = old.join(j, "ticker", "full")
    none, touched = F.lit(0).cast("long"), F.col("found").isNotNull() | F.col("failed").isNotNull()
    return j.select(
        "ticker", F.when(touched, now).otherwise(F.col("last_check")).alias("last_check"), F.greatest("last_filing", "new_filing").alias("last_filing"), (F.coalesce("filings", none) + F.coalesce("found", none)).alias("filings"),
        F.when(F.col("failed"), F.coalesce("failures", none) + 1).when(F.col("found").isNotNull(), none).otherwise(F.coalesce("failures", none)).alias("failures"),
    )


def stream_notify(filings: DataFrame, deals: DataFrame) -> DataFrame:
    """O2. Stream-static join: every tenant that follows the ticker."""
    return filings.join(deals.select("ticker", "tenant_id").distinct(), "ticker")


def expire(notices: DataFrame, now: str, days: int = 30) -> DataFrame:
    """O2. Notices of the last ``days`` days."""
    return notices.filter(F.col("ts") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def _counts(log: DataFrame, window, *keys: str) -> DataFrame:
    return log.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"), F.sum(F.coalesce("latency", F.lit(0.0)).cast("decimal(20,4)")).alias("latency"))


def stream_log_rates(log: DataFrame, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """O3. Rolling usage per tenant."""
    return _counts(timed(log), F.window("ts", length, slide), "tenant")


def stream_counters(log: DataFrame) -> DataFrame:
    """O4. Five-minute counters by method."""
    return _counts(timed(log), F.window("ts", "5 minutes"), "method")


def stream_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """O5. Sessions that end after ``gap`` without events, with their totals."""
    return timed(log).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("latency", F.lit(0.0)).cast("decimal(20,4)")).alias("total"))


def stream_rates(log: DataFrame, limit: int, length: str = "1 minute") -> DataFrame:
    """O6. Windows with more requests than allowed."""
    return timed(log).groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def ingest_batch(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], quarantine: Callable[[DataFrame], None], keys: Sequence[str], valid) -> Callable[[DataFrame, int], None]:
    """O8. A ``foreachBatch`` function: rows that pass ``valid`` are upserted, the others
    go to quarantine. A batch that is run again gives the same target."""

    def run(batch: DataFrame, _: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        good, target = batch.filter(ok), read()
        write(good.dropDuplicates(list(keys)) if target is None else upsert(target, good, keys))
        quarantine(batch.filter(~ok))

    return run
