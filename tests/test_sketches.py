"""Mergeable latency profiles against exact ones."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import logs
from tallyfold.operators import sketches as op
from tallyfold.sources.bindings import log

SF = "/root/testdata/sf0.01"
ROW = "tenant long, method string, ts timestamp, latency double, success boolean"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    rows = log(spark, SF)
    for k in range(3):  # batches that share windows
        op.store(op.windowed(rows.filter(F.col("event_id") % 3 == k)), path, k)
    return path


def test_rolled_profiles_are_near_the_exact_ones(spark, store):
    rows, parts = log(spark, SF), op.stored(spark, store)
    for keys in (["method"], ["tenant"], ["tenant", "method"]):
        got = op.checked(op.profile(op.rolled(parts, keys)), rows, keys).collect()
        want = {tuple(r[k] for k in keys): r for r in logs.latency_profile(rows, keys).collect()}
        assert len(got) == len(want)
        for r in got:
            w = want[tuple(r[k] for k in keys)]
            assert r.p50_near and r.p95_near and r.p99_near
            assert all(r[c] == w[c] for c in ("n", "min", "max", "healthy", *(f"over_{x}" for x in logs.LIMITS)))
            assert r.avg == pytest.approx(w.avg, abs=1e-4)


def test_merging_in_steps_and_compacting_keeps_the_counts(spark, store, tmp_path):
    parts = op.stored(spark, store)
    once = op.rolled(parts, ["method"]).drop("sketch")
    steps = op.rolled(op.rolled(op.rolled(parts, ["tenant", "method"], "hour"), ["tenant", "method"], "day"), ["method"]).drop("sketch")
    op.compacted(parts, ["tenant", "method"], str(tmp_path / "c"))
    small = op.stored(spark, str(tmp_path / "c"))
    assert small.count() == parts.select("tenant", "method", "start").distinct().count() < parts.count()
    assert sorted(once.collect()) == sorted(steps.collect()) == sorted(op.rolled(small, ["method"]).drop("sketch").collect())
    got = op.checked(op.profile(op.rolled(op.rolled(small, ["tenant", "method"], "hour"), ["method"])), log(spark, SF), ["method"])
    assert got.filter("not (p50_near and p95_near and p99_near)").count() == 0


def test_profiles_read_no_log_and_only_their_days(spark, store):
    week = op.profile(op.rolled(op.stored(spark, store, "2024-01-05", "2024-01-12"), ["method"]))
    assert all("/batch=" in f for f in week.inputFiles())
    assert "PartitionFilters: [isnotnull(day" in week._jdf.queryExecution().toString()
    want = logs.latency_profile(log(spark, SF).filter("ts >= '2024-01-05' and ts < '2024-01-12'"), ["method"])
    assert sorted((r.method, r.n) for r in week.collect()) == sorted((r.method, r.n) for r in want.collect())


def test_a_batch_again_replaces_itself(spark, tmp_path):
    rows, path = log(spark, SF), str(tmp_path / "p")
    run = op.sketch_batch(path)
    for number, part in ((0, 0), (1, 1), (1, 1), (0, 0)):
        run(rows.filter(F.col("event_id") % 2 == part), number)
    assert op.stored(spark, path).agg(F.sum("rows")).first()[0] == rows.count()


def test_stream_of_parts_equals_the_batch(spark, tmp_path):
    rows = log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "src"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    for _ in range(2):  # the second run finds nothing new
        q = src.writeStream.foreachBatch(op.sketch_batch(str(tmp_path / "p"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert len(list(Path(tmp_path / "p").glob("batch=*"))) == 3
    of = lambda parts: sorted(op.rolled(parts, ["tenant", "method"], "hour").drop("sketch").collect())
    assert of(op.stored(spark, str(tmp_path / "p"))) == of(op.windowed(rows))


def test_percentiles_at_indexes_are_exact_for_few_rows(spark):
    rows = log(spark, SF).filter("event_id % 50 = 0")
    got = op.metrics(op.rolled(op.windowed(rows), ["method"])).select("method", "n", "p50", "p99", "success_rate")
    assert sorted(got.collect()) == sorted(logs.resolution_metrics(rows).collect())


def test_odd_rows(spark):
    rows = spark.sql(
        "select * from values (1L, 'a', timestamp '2024-01-01 00:01:00', cast(null as double), true), (1L, 'a', timestamp '2024-01-01 00:02:00', double('nan'), null), (1L, 'a', null, 1.0D, true),"
        " (2L, null, timestamp '2024-01-01 00:01:00', 7.0D, true), (2L, null, timestamp '2024-01-01 00:01:00', 7.0D, true), (2L, null, timestamp '2024-01-01 00:09:00', double('infinity'), false) t(tenant, method, ts, latency, success)"
    ).withColumn("sketch", F.lit("x"))
    got = {r.method: r for r in op.profile(op.rolled(op.windowed(rows), ["method"])).collect()}
    assert (got["a"].rows, got["a"].n, got["a"].failures, got["a"].p50, got["a"].avg, got["a"].healthy) == (2, 0, 1, None, None, True)
    assert (got[None].rows, got[None].n, got[None].p50, got[None].over_5, got[None].failures) == (3, 3, 7.0, 3, 1) and math.isinf(got[None].p99)
    assert op.profile(op.rolled(op.windowed(spark.createDataFrame([], ROW)), ["method"])).count() == 0
    assert op.windowed(rows).count() == 3
