"""Streams with keyed state, over restarts from a checkpoint, against their batch form."""

import os

import pytest
from pyspark.sql import functions as F

from tallyfold.streaming import jobs, state

START = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def one_store(spark):
    """One state store a query: each costs a Python process a micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, folder, k, rows, schema):
    """File ``k`` of a stream's source; ``second`` becomes the event time."""
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("second") + START)).drop("second").coalesce(1).write.parquet(f"{folder}/{k}")
    os.utime(next((folder / str(k)).glob("part*")), (1e9 + k, 1e9 + k))


def read(spark, folder):
    return spark.readStream.schema(spark.read.parquet(f"{folder}/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(spark, job, folder, tmp_path):
    """One start of the query: what it writes is added to what earlier starts wrote."""
    q = job(read(spark, folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.read.parquet(str(tmp_path / "out"))


CHECKS = "ticker string, accession string, failed boolean, second long"


def test_detection_goes_on_after_a_restart(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    parts = [
        [("A", "1", False, 0), ("A", "2", False, 5), ("B", "9", None, 1), ("C", None, True, 3)],
        [("A", "2", False, 20), ("A", "3", False, 21), ("C", None, True, 22), ("B", None, False, 23), (None, "x", False, 24)],
        [("C", "7", False, 40), ("A", None, True, 41), ("A", "1", False, 39), ("B", "9", False, 45), ("A", None, True, 46)],
    ]
    for k in (0, 1):
        put(spark, src, k, parts[k], CHECKS)
    first = run(spark, state.stream_detection, src, tmp_path).filter("accession is not null").count()
    assert first == 4
    put(spark, src, 2, parts[2], CHECKS)
    out = run(spark, state.stream_detection, src, tmp_path)
    new = sorted((r.ticker, r.accession) for r in out.filter("accession is not null").collect())
    assert new == [("A", "1"), ("A", "2"), ("A", "3"), ("B", "9"), ("C", "7")]
    cols = ["ticker", "last_check", "last_filing", "filings", "failures"]
    last = out.filter("accession is null").groupBy("ticker").agg(F.max_by(F.struct(*cols[1:]), "last_check").alias("s")).select("ticker", "s.*")
    want = state.detections(spark.read.parquet(f"{src}/*"))
    assert sorted(map(tuple, last.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert {r.ticker: (r.filings, r.failures) for r in want.collect()} == {"A": (3, 2), "B": (1, 0), "C": (1, 0)}


EVENTS = "user_id string, latency double, second long"


def test_sessions_end_once_and_late_rows_come_aside(spark, tmp_path):
    src, minute = tmp_path / "src", 60
    src.mkdir()
    parts = [
        [("u", 1.0, 0), ("u", 2.5, 10 * minute), ("v", None, 5 * minute), ("u", 4.0, 100 * minute)],
        [("u", 8.0, 35 * minute), ("v", 1.25, 300 * minute), (None, 1.0, 1)],  # the first joins the first session: within the hour that is waited
        [("w", 1.0, 900 * minute), ("v", 2.0, 310 * minute)],
        [("u", 7.0, 20 * minute), ("w", 1.0, 905 * minute)],  # comes when its session is long over
        [("x", 1.0, 5000 * minute)],
        [("x", 1.0, 5001 * minute)],
    ]
    job = lambda s: state.stream_expired_sessions(s, 30, "1 hour")
    for k in range(3):
        put(spark, src, k, parts[k], EVENTS)
    run(spark, job, src, tmp_path)
    for k in range(3, 6):
        put(spark, src, k, parts[k], EVENTS)
    out = run(spark, job, src, tmp_path).select("user_id", "kind", ((F.unix_timestamp("from_ts") - START) / 60).cast("int"), ((F.unix_timestamp("to_ts") - START) / 60).cast("int"), "n", F.col("total").cast("double"))
    got = sorted(map(tuple, out.collect()))
    sessions = [r for r in got if r[1] == "session"]
    assert sessions == [("u", "session", 0, 35, 3, 11.5), ("u", "session", 100, 100, 1, 4.0), ("v", "session", 5, 5, 1, 0.0), ("v", "session", 300, 310, 2, 3.25), ("w", "session", 900, 905, 2, 2.0)]
    assert [r for r in got if r[1] == "late"] == [("u", "late", 20, 20, 1, 7.0)]
    # the batch form, without what came late and what has not ended
    batch = jobs.stream_sessions(spark.createDataFrame([r for p in parts for r in p if r[0] and r[1:] != (7.0, 20 * minute) and r[0] != "x"], EVENTS).withColumn("ts", F.timestamp_seconds(F.col("second") + START)))
    assert sorted((r.user_id, r.n, float(r.total)) for r in batch.collect()) == sorted((r[0], r[4], r[5]) for r in sessions)
