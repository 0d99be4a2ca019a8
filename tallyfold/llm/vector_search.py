"""Exact top-k inner products by multi-resolution segment statistics.

A vector of width d is cut into segments; of each, the sum and the deviation from the
mean are kept, at several resolutions. For two vectors and any segmentation

    x . q  <=  sum over segments of  w * mean_x * mean_q + dev_x * dev_q

(w: segment width, dev: norm of the centred segment), which is the same as a lower
bound on their distance. A candidate whose bound, coarse to fine, does not reach the
query's k-th best so far is dropped; exact products are computed for survivors.

Work is dealt in blocks: queries are packed into blocks of at most ``QUERY_BLOCK``,
candidates, partition by partition, into blocks of at most ``ROW_BLOCK``. Every query
starts from the k-th best of one sample of ``SAMPLE`` candidates, so all blocks prune by
a bound that holds for the whole table. One block of queries is sent to every task; more
are dealt by (candidate group, query group): a query block goes to each candidate group,
a candidate block to each query group, and every pair of blocks meets once. There are
few query groups, only as many as keep all tasks busy, so it is mostly the queries, the
smaller side, that are sent several times. A pair of blocks hands on at most k rows per
query, and no task holds more than one block of either.

Results on odd input: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; shorter vectors count as padded with zeros, very long
ones are compared whole; repeated rows are candidates (and queries) once each, a query
never meets rows of its own id; fewer than k candidates give fewer rows; ties go to the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import lowest, table

SCALE, TOP = 1024, 10
QUERY_BLOCK, ROW_BLOCK, SAMPLE = 1024, 4096, 4096
GROUP_BLOCKS = 64  # candidate blocks of a group
SEGMENTS = (4, 16)
PACKED = "n long, width long, ids binary, data binary"


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has only finite components, as vec_id and scaled integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return df.filter("vec_id is not null and embedding is not null").filter(finite).select("vec_id", scaled.alias("v"))


def _pack(ids: list[int], rows: list) -> tuple[int, int, bytes, bytes]:
    width = max(map(len, rows), default=0)
    x = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    return len(ids), width, np.array(ids, np.int64).tobytes(), x.tobytes()


def packed(df: DataFrame, size: int) -> DataFrame:
    """Rows of a partition packed into blocks of at most ``size`` vectors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def out() -> pa.RecordBatch:
            n, width, a, b = _pack(ids, rows)
            ids.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["n", "width", "ids", "data"])

        for batch in it:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield out()
        if ids:
            yield out()

    return df.mapInArrow(run, PACKED)


def unpacked(n: int, width: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(n, width)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment: mean * sqrt(width), and the norm of the centred segment."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        part = x[:, a:b].astype(float)
        m = part.mean(1)
        means.append(m * np.sqrt(b - a))
        devs.append(np.sqrt(np.maximum((part * part).sum(1) - (b - a) * m * m, 0)))
    return np.array(means + devs).T.reshape(len(x), -1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles while every sum stays below 2^53,
    in Python integers (then clipped to a long) beyond."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if top < 2**53:
        return np.rint(x.astype(float) @ q.astype(float).T).astype(np.int64)
    exact = x.astype(object) @ q.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def kth_best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some candidates; the least number if fewer."""
    least = np.iinfo(np.int64).min
    if len(x) < k:
        return np.full(len(q), least)
    got = np.where(ids[:, None] == qids[None, :], least, products(x, q))
    return np.partition(got, len(got) - k, 0)[len(got) - k]


def same_width(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    width = max(x.shape[1], q.shape[1])
    return [np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, q)]


def best_of_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): each query's k best of the block among those that reach
    its ``floor``; ties beyond k go to the smaller id."""
    x, q = same_width(x, q)
    stats = [(segment_statistics(x, n), segment_statistics(q, n)) for n in SEGMENTS] if x.shape[1] else []
    out = []
    pilot = min(len(x), 64 * k)
    floor = np.maximum(floor, kth_best(ids[:pilot], x[:pilot], qids, q, k)).astype(float)
    alive = np.ones((len(x), len(q)), bool)
    for sx, sq in stats:  # coarse to fine, finer bounds only for the rows still wanted
        rows = np.flatnonzero(alive.any(1))
        bound = sx[rows] @ sq.T
        alive[rows] &= bound + 1e-6 * np.abs(bound) + 1 >= floor
    alive &= ids[:, None] != qids[None, :]
    for j in np.flatnonzero(alive.any(0)):
        rows = np.flatnonzero(alive[:, j])
        s = products(x[rows], q[j : j + 1])[:, 0]
        for r in np.lexsort((ids[rows], -s))[:k]:
            out.append((int(qids[j]), int(ids[rows[r]]), int(s[r])))
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: exact, ties to the smaller vec_id."""
    spark = rows.sparkSession
    n_queries, n_rows = queries.count(), rows.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    dealt = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("qb"))
    sample = lowest(rows, SAMPLE, "vec_id").collect()
    some = unpacked(*_pack([r.vec_id for r in sample], [r.v for r in sample]))

    def pack_queries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for at in range(0, len(pdf), QUERY_BLOCK):
            part = pdf.iloc[at : at + QUERY_BLOCK]
            n, width, ids, data = _pack(part["vec_id"].tolist(), part["v"].tolist())
            x, q = same_width(some[1], unpacked(n, width, ids, data)[1])
            made.append((int(key[0]), n, width, ids, data, kth_best(some[0], x, np.frombuffer(ids, np.int64), q, k).tobytes()))
        return pd.DataFrame(made, columns=["qb", "qn", "qwidth", "qids", "qdata", "qfloor"])

    q = dealt.groupBy("qb").applyInPandas(pack_queries, "qb int, qn long, qwidth long, qids binary, qdata binary, qfloor binary")
    c = packed(rows, ROW_BLOCK)
    if blocks == 1:
        pairs = c.withColumn("one", F.lit(1)).join(F.broadcast(q.withColumn("one", F.lit(1))), "one")
    else:
        c_groups = max(1, n_rows // (GROUP_BLOCKS * ROW_BLOCK))
        q_groups = min(blocks, max(1, -(-4 * spark.sparkContext.defaultParallelism // c_groups)))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        c = c.withColumn("cg", F.pmod(F.xxhash64("ids"), F.lit(c_groups))).select("*", each(q_groups).alias("qg"))
        q = q.withColumn("qg", F.pmod(F.xxhash64("qids"), F.lit(q_groups))).select("*", each(c_groups).alias("cg"))
        pairs = c.join(q, ["cg", "qg"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, x = unpacked(r["n"], r["width"], r["ids"], r["data"])
                qids, qx = unpacked(r["qn"], r["qwidth"], r["qids"], r["qdata"])
                found = list(zip(*best_of_block(ids, x, qids, qx, np.frombuffer(r["qfloor"], np.int64), k), strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return top_k(rows.filter("vec_id % 100 = 0"), rows)


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
