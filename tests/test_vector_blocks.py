"""Scores by blocks against the plain join of every query with every row."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators import search, vector_blocks
from tallyfold.operators.text import cosine
from tallyfold.sources.scratch import scratch_path


def plain(queries, rows, k):
    pairs = rows.crossJoin(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))).filter("id <> query_id")
    scored = pairs.select("query_id", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sorted((r.query_id, r["rank"], r.id, repr(r.score)) for r in scored.withColumn("rank", rank).filter(F.col("rank") <= k).collect())


@pytest.mark.parametrize("part_rows", [37, 100_000])
def test_equal_to_the_plain_join(spark, monkeypatch, part_rows):
    """Copies, ties, lengths of 0, nulls, not-a-number, other widths, repeated ids."""
    monkeypatch.setattr(vector_blocks, "PART_ROWS", part_rows)
    rng = np.random.default_rng(3)
    x = [[float(c) for c in v] for v in rng.normal(size=(120, 4)).astype("float32")]
    rows = [(i, v) for i, v in enumerate([*x, *x[:30], *x[:30], *[x[0]] * 20, *[[c * 3 for c in v] for v in x[:9]]])]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [0.0] * 4), (1003, [1.0, 2.0]), (1004, []), (1005, [float("nan"), 0.0, 0.0, 1.0]), (1006, [float("inf"), 0.0, 0.0, 1.0]), (None, x[1]), (7, x[8]), (7, x[7]), (7, x[3])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    queries = df.filter("id % 10 = 0 or id >= 1000").filter("id is not null")
    got = search.vector_top_k(queries, df, 6, limit=5)
    assert sorted((r.query_id, r["rank"], r.id, repr(r.score)) for r in got.collect()) == plain(queries, df, 6)


def test_no_pair_leaves_its_task(spark):
    """Hashing and exact search hand on k rows per query and part, however many share a bucket."""
    df = spark.range(4000).select("id", F.array(F.rand(1), F.rand(2), F.lit(1.0)).alias("v"))
    for out in (search.vector_top_k(df.filter("id % 100 = 0"), df, 3), search.ann_top_k(df.filter("id % 100 = 0"), df, 3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "Join" not in plan
        assert out.count() == 120


def test_half_up():
    x = np.array([93 / 128, -93 / 128, 0.1234565, 0.9999995, 0.0, float("nan"), 1e-9])
    assert list(map(repr, vector_blocks.half_up(x, 6).tolist())) == ["0.726563", "-0.726563", "0.123457", "1.0", "0.0", "nan", "0.0"]


def test_inverted_file_scores_by_list(spark):
    """Unusable vectors are left out; of a list no more than k rows a query leave their task."""
    from tallyfold.operators import vector_index

    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [])], "id long, v array<float>")
    assert [(r.id, r.u) for r in vector_index.unit(df).collect()] == [(1, [0.6, 0.8])]
    many = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v"))
    index = vector_index.InvertedFile.build(many, scratch_path(spark, "blocks"), lists=4)
    plan = index.search(many.filter("id % 500 = 0"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_first_stage_is_no_window(spark):
    """K1: a query's hits, nearly all chunks perhaps, do not meet in one task with their texts."""
    chunks = spark.createDataFrame([(i, 0, "the revenue grew") for i in range(9)], "doc_id int, chunk_index int, content string")
    queries = spark.createDataFrame([(1, "x", ["the"])], "query_id int, phrase string, terms array<string>")
    out = search.search_chunks(queries, chunks, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Window [" in line and "min(" in line]
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3]
