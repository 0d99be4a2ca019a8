"""O1, O5, O9 with keyed state: detection per ticker, sessions that end by a timer.

State is Spark's, in its RocksDB store below the query's checkpoint, so a query that is
started again goes on where it was. ``keyed_state`` chooses that store for a session that
has chosen none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfold.operators.facts import ranked
from tallyfold.streaming.jobs import LATE

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def keyed_state(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


# times are milliseconds inside the processors, whatever the session's time zone
DETECTED = "ticker string, accession string, ts long, last_check long, last_filing long, filings long, failures long"


class Detection(StatefulProcessor):
    """O1. Of each ticker: the accessions seen, each for ``keep_days`` of event time by a
    timer, and last check, last filing, filings and consecutive failures, which are
    forgotten when the ticker has had no check for as long."""

    def __init__(self, keep_days: int) -> None:
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "accession string", "at long")
        self.about = handle.getValueState("about", "last_check long, last_filing long, filings long, failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        check, filing, filings, failures = self.about.get() if self.about.exists() else (None, None, 0, 0)
        out = []
        got = pd.concat(list(rows)).sort_values(["at", "accession"], na_position="first")
        ends = set()
        for accession, ts, failed in zip(got["accession"], got["at"].tolist(), got["failed"], strict=True):
            ends.add(ts + self.keep)
            check = ts if check is None else max(check, ts)
            failures = failures + 1 if failed else 0
            if accession is not None and not failed and not self.seen.containsKey((accession,)):
                self.seen.updateValue((accession,), (ts,))
                filings, filing = filings + 1, ts if filing is None else max(filing, ts)
                out.append((key[0], accession, ts, check, filing, filings, failures))
        self.about.update((check, filing, filings, failures))
        out.append((key[0], None, check, check, filing, filings, failures))
        for end in ends:
            self.handle.registerTimer(end)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DETECTED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        for accession in [k[0] for k, v in self.seen.iterator() if v[0] + self.keep <= end]:
            self.seen.removeKey((accession,))
        if self.about.exists() and self.about.get()[0] + self.keep <= end:
            self.about.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in DETECTED.split(", ")])

    def close(self) -> None:
        pass


def stream_detection(checks: DataFrame, keep_days: int = 400) -> DataFrame:
    """O1. A row for each accession of a ticker that was not seen before, and for each
    micro-batch one without an accession: the ticker's state after it. ``checks``:
    (ticker, accession, ts, failed), a row per filing that a check found, one without an
    accession for a check that found none, and failed ones."""
    keyed_state(checks.sparkSession)
    rows = checks.withColumn("ts", F.col("ts").cast("timestamp")).filter("ticker is not null and ts is not null").withWatermark("ts", LATE)
    # without the watermarked column itself: a late filing is a new filing like any
    rows = rows.select(F.col("ticker").cast("string"), F.col("accession").cast("string"), F.coalesce("failed", F.lit(False)).alias("failed"), F.unix_millis("ts").alias("at"))
    found = rows.groupBy("ticker").transformWithStateInPandas(Detection(keep_days), DETECTED, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("ts", "last_check", "last_filing")})


def detections(checks: DataFrame) -> DataFrame:
    """O1 as a batch: each ticker's state after all checks."""
    rows = checks.filter("ticker is not null and ts is not null").select("ticker", "accession", F.col("ts"), F.coalesce("failed", F.lit(False)).alias("failed"))
    first = ranked(rows.filter("accession is not null and not failed"), ["ticker", "accession"], "ts")
    found = first.groupBy("ticker").agg(F.max("ts").alias("last_filing"), F.count("*").alias("filings"))
    # failures after the last check that did not fail
    order = W.partitionBy("ticker").orderBy(F.desc("ts"), F.desc_nulls_last("accession")).rowsBetween(W.unboundedPreceding, 0)
    runs = rows.withColumn("failing", F.min("failed").over(order)).groupBy("ticker").agg(F.max("ts").alias("last_check"), F.count_if("failing").alias("failures"))
    return runs.join(found, "ticker", "left").select("ticker", "last_check", "last_filing", F.coalesce("filings", F.lit(0)).alias("filings"), "failures")


ENDED = "user_id string, kind string, from_ts long, to_ts long, n long, total long"


class Sessions(StatefulProcessor):
    """O5. Open sessions of a user by their first event; a timer at the end of each."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "last long, n long, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, late = timerValues.getCurrentWatermarkInMs(), []
        open_ = {k[0]: tuple(v) for k, v in self.open.iterator()}
        before = dict(open_)
        for pdf in rows:
            for at, amount in zip(pdf["at"].tolist(), pdf["amount"].tolist(), strict=True):
                if at + self.gap <= mark:  # its session has ended already
                    late.append((key[0], "late", at, at, 1, amount))
                    continue
                start, last, n, total = at, at, 1, amount
                for s in [s for s, (e, _, _) in open_.items() if s < at + self.gap and at < e + self.gap]:
                    e, k, t = open_.pop(s)
                    start, last, n, total = min(start, s), max(last, e), n + k, total + t
                open_[start] = (last, n, total)
        for s, v in before.items():
            if open_.get(s) != v:
                self.open.removeKey((s,))
                self.handle.deleteTimer(v[0] + self.gap)
        for s, v in open_.items():
            if before.get(s) != v:
                self.open.updateValue((s,), v)
        for last, _, _ in open_.values():  # two sessions may end at once
            self.handle.registerTimer(last + self.gap)
        yield pd.DataFrame(late, columns=[c.split()[0] for c in ENDED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        done = [(k[0], tuple(v)) for k, v in self.open.iterator() if v[0] + self.gap <= end]
        for start, _ in done:
            self.open.removeKey((start,))
        yield pd.DataFrame([(key[0], "session", s, last, n, total) for s, (last, n, total) in done], columns=[c.split()[0] for c in ENDED.split(", ")])

    def close(self) -> None:
        pass


def stream_expired_sessions(log: DataFrame, gap_minutes: int = 30, late: str = LATE) -> DataFrame:
    """O5, O9. Each session once, when ``gap_minutes`` have passed without an event (in event
    time, ``late`` behind the newest event): kind ``session``, first and last event, number
    and total. An event that comes when its session would have ended already is no part of
    any: it comes out at once as kind ``late``, to be counted or stored aside."""
    keyed_state(log.sparkSession)
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id is not null and ts is not null").withWatermark("ts", late)
    # without the watermarked column itself, by which Spark would leave late rows out unseen
    amount = F.coalesce((F.col("latency").cast("decimal(20,4)") * 10_000).cast("long"), F.lit(0))
    rows = rows.select(F.col("user_id").cast("string"), F.unix_millis("ts").alias("at"), amount.cast("long").alias("amount"))
    ended = rows.groupBy("user_id").transformWithStateInPandas(Sessions(gap_minutes * 60_000), ENDED, "Append", "EventTime")
    total = (F.col("total").cast("decimal(20,0)") / 10_000).cast("decimal(20,4)")
    return ended.select("user_id", "kind", *(F.timestamp_millis(c).alias(c) for c in ("from_ts", "to_ts")), "n", total.alias("total"))
