"""Structured Streaming jobs with availableNow, against their batch form."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyfold.sources.bindings import log
from tallyfold.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream_of(spark, tmp_path_factory):
    def make(df, files=3):
        df = df.withColumn("second", F.col("ts").cast("timestamp").cast("double"))
        path = str(tmp_path_factory.mktemp("src"))
        # one file after the other, in the order of their names: streams read the oldest first
        ends = df.approxQuantile("second", [k / files for k in range(1, files)], 0) if files > 1 else []
        for k, (a, b) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
            part = df.filter((F.lit(a is None) | (F.col("second") > a)) & (F.lit(b is None) | (F.col("second") <= b)))
            part.drop("second").coalesce(1).write.parquet(f"{path}/{k}")
            os.utime(next(Path(path, str(k)).glob("part*")), (1e9 + k, 1e9 + k))
        df, path = df.drop("second"), f"{path}/*"
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_new_filings_once_each(spark, stream_of, tmp_path):
    rows = log(spark, SF).select(F.col("user_id").alias("ticker"), F.col("event_id").alias("accession"), "ts")
    got = run(spark, jobs.stream_new_filings(stream_of(rows.unionByName(rows), 1)), "o1", tmp_path)
    assert sorted(r.accession for r in got.collect()) == sorted(r.accession for r in rows.collect())


@pytest.mark.parametrize(("job", "keys"), [(jobs.stream_counters, ["method"]), (jobs.stream_log_rates, ["tenant"]), (jobs.stream_sessions, ["user_id"]), (lambda s: jobs.stream_rates(s, 1, "1 hour"), [])])
def test_windows_equal_batch(spark, stream_of, tmp_path, job, keys):
    rows = log(spark, SF)
    name = f"w{'_'.join(keys)}"
    got = run(spark, job(stream_of(rows)), name, tmp_path, "complete")
    cols = [*keys, F.col("w.start").cast("string"), "n"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, job(rows).select(*cols).collect()))


def test_notify_joins_the_static_side(spark, stream_of, tmp_path):
    rows = log(spark, SF).select(F.col("user_id").alias("ticker"), "event_id", "ts")
    deals = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "ticker long, tenant_id int")
    got = run(spark, jobs.stream_notify(stream_of(rows), deals), "o2", tmp_path)
    assert got.count() == rows.filter("ticker in (1, 2)").count()


def test_ingest_is_idempotent_and_quarantines(spark, stream_of, tmp_path):
    rows = log(spark, SF).select("event_id", "method", "latency", "ts")
    state = {"target": None, "bad": 0}

    def write(df):
        path = str(tmp_path / f"v{state.get('n', 0)}")
        state["n"] = state.get("n", 0) + 1
        df.write.parquet(path)
        state["target"] = spark.read.parquet(path)

    def quarantine(df):
        state["bad"] += df.count()

    each = jobs.ingest_batch(lambda: state["target"], write, quarantine, ["event_id"], F.col("method") != "error")
    for k in range(2):  # the second run sees every row again
        stream_of(rows).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination(120)
    assert state["target"].count() == rows.filter("method <> 'error'").count()
    assert state["bad"] == 2 * rows.filter("method = 'error'").count()


def test_late_rows(spark, tmp_path):
    """O9. Rows within a day of the newest are counted, later ones are left out; what goes
    by key takes them whenever they come."""
    start, day = 1_700_000_000, 86_400
    times = [[0, 60, 3 * day], [3 * day - 3600, 120], [3 * day + 7200]]  # of the second file one row is late by an hour, one by days
    for k, some in enumerate(times):
        rows = spark.createDataFrame([(k * 10 + j, "view", 1.0, True, start + t) for j, t in enumerate(some)], "event_id int, method string, latency double, success boolean, second long")
        rows.withColumn("ts", F.timestamp_seconds("second")).drop("second").coalesce(1).write.parquet(f"{tmp_path}/src/{k}")
        os.utime(next((tmp_path / "src" / str(k)).glob("part*")), (1e9 + k, 1e9 + k))
    schema = spark.read.parquet(f"{tmp_path}/src/0").schema
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    got = run(spark, jobs.stream_counters(read()), "late", tmp_path / "a", "update")
    counted = {r.s for r in got.select((F.col("w.start").cast("long") - start).alias("s")).collect()}
    assert any(3 * day - 3900 <= s <= 3 * day - 3600 for s in counted) and max(counted) >= 3 * day + 6900
    early = got.filter(F.col("w.start").cast("long") < start + 300).agg(F.max("n")).first()[0]
    assert early == 2  # the row at 120 came days late
    ids = run(spark, jobs.stream_new_filings(read().select(F.lit(1).alias("ticker"), F.col("event_id").alias("accession"), "ts")), "late2", tmp_path / "b")
    assert ids.count() >= 5


def test_detection_state(spark):
    def rows(*x):
        return spark.createDataFrame(x, "ticker string, accession string, second long").withColumn("ts", F.timestamp_seconds("second"))

    one = jobs.detection_state(None, rows(("A", "1", 100), ("A", "2", 200), ("B", "3", 50)), "2024-01-01 00:00:00")
    two = jobs.detection_state(one, rows(("A", "4", 300)), "2024-01-02 00:00:00", spark.createDataFrame([("B",)], "ticker string"))
    three = jobs.detection_state(two, rows(), "2024-01-03 00:00:00", spark.createDataFrame([("B",)], "ticker string"))
    got = {r.ticker: (r.last_filing.timestamp(), r.filings, r.failures, str(r.last_check)[:10]) for r in three.withColumn("last_check", F.col("last_check").cast("string")).collect()}
    assert {k: v[1:] for k, v in got.items()} == {"A": (3, 0, "2024-01-02"), "B": (1, 2, "2024-01-03")}
