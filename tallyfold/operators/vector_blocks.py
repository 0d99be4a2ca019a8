"""Scores of vectors against queries, block by block: F3, K3 and K7 rank by it.

Rows and queries meet in groups that their caller deals. Of each group a task gets both
sides, multiplies them as matrices and hands on each query's best ``k``, so no pair leaves
its task. Products are rounded otherwise than sums in order, so they only tell which pairs
are near enough to the k-th best; those pairs' scores are summed in order, as
``text.cosine`` does it, and are the same to the last bit.

Odd input as in ``text.cosine``: a pair with a null vector, a null component or two widths
scores 0, as does one with a vector of length 0; not-a-number ranks first. Rows without an
id take no part. Of equal scores the smaller id goes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PART_ROWS, QUERY_BLOCK = 32_768, 16_384  # rows and queries that meet in one group
TILE_ROWS, TILE_QUERIES, PAIRS = 1024, 1024, 65_536  # of a product, and pairs scored at once


def matrix(col: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles padded with zeros, and their widths; -1: null or with a null."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    lengths = np.array(col.value_lengths().fill_null(-1))
    if len(col) and lengths.min() == width and col.flatten().null_count == 0:
        return np.asarray(col.flatten(), np.float64).reshape(len(col), width), lengths
    out = np.zeros((len(col), width))
    for i, v in enumerate(col.to_pylist()):
        if v is None or None in v:
            lengths[i] = -1
        else:
            out[i, : len(v)] = v
    return out, lengths


def width_of(col: pa.Array | pa.ChunkedArray) -> int:
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    return max((int(np.array(c.value_lengths().fill_null(0)).max(initial=0)) for c in chunks), default=0)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, 1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: by the number's shortest decimal form, halves away from zero."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        whole[i] = int((Decimal(repr(float(abs(x[i])))) * 10**digits).to_integral_value(ROUND_HALF_UP))
    return np.where(np.isfinite(x), np.copysign(whole / 10.0**digits, x) + 0.0, x)


def _order(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.inf, x)


def _first_k(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first of each ``q``: high scores, then small ids."""
    by = np.lexsort((ids, -_order(score), q))
    starts = np.flatnonzero(np.r_[True, q[by][1:] != q[by][:-1]]) if len(by) else np.zeros(0, int)
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[place < k]


def _copies(x: np.ndarray, w: np.ndarray, codes: np.ndarray | None, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each distinct vector, the rows in order of vector and id, and where each
    vector's begin. Of an id's copies ``k`` stay, of a vector's rows 2 ``k``: without a
    query's own there are k left."""
    key = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), w.astype(np.int64).view(np.uint8).reshape(len(x), -1)]
    key += [] if codes is None else [np.ascontiguousarray(codes).view(np.uint8).reshape(len(x), -1)]
    flat = np.ascontiguousarray(np.hstack(key))
    _, group = np.unique(flat.view(f"V{flat.shape[1]}").ravel(), return_inverse=True)
    by = np.lexsort((ids, group))
    for key, most in ((np.stack([group, ids], 1), k), (group[:, None], 2 * k)):
        same = np.r_[True, (key[by][1:] != key[by][:-1]).any(1)]
        starts = np.flatnonzero(same)
        by = by[np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)])) < most]
    starts = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
    return by[starts], by, np.r_[starts, len(by)]


def best_of_group(rows: pa.Table, queries: pa.Table, k: int, unit: bool, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of a query, position of a row, score) of each query's best ``k``. With a
    column ``codes`` on both sides only pairs that share one at the same place count."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if not rows.num_rows or not queries.num_rows:
        return none
    width = max(width_of(rows["v"]), width_of(queries["q"]))
    (x, wx), (q, wq) = matrix(rows["v"], width), matrix(queries["q"], width)
    codes = [np.array(t["codes"].to_pylist()) if "codes" in t.column_names else None for t in (rows, queries)]
    own = np.array([*rows["id"].to_pylist(), *queries["query_id"].to_pylist()])
    _, ids = np.unique(own, return_inverse=True)
    ids, qids = ids[: len(x)], ids[len(x) :]
    one, members, begin = _copies(x, wx, codes[0], ids, k)
    own_rows = int(np.bincount(ids[members]).max())  # as many may be a query's own
    u, wu, cu = x[one], wx[one], None if codes[0] is None else codes[0][one]
    with np.errstate(all="ignore"):
        nu, nq = (np.ones(len(u)), np.ones(len(q))) if unit else (norms(u), norms(q))
        near_u, near_q = (np.nan_to_num(a / np.where(n == 0, 1, n)[:, None], nan=0.0, posinf=0.0, neginf=0.0) for a, n in ((u, nu), (q, nq)))
    odd_u, odd_q = (~np.isfinite(a.sum(1)) | ~np.isfinite(n) for a, n in ((u, nu), (q, nq)))
    mixed = len(np.unique(np.r_[wu, wq])) > 1 or wu.min() < 0 or wq.min() < 0
    slack = (0 if digits is None else 2 * 10.0**-digits) + 1e-9

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.empty(len(a))
        for lo in range(0, len(a), PAIRS):
            i, j = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
            with np.errstate(all="ignore"):
                s = np.cumsum(u[i] * q[j], 1)[:, -1] if width else np.zeros(len(i))
                if not unit:
                    length = nu[i] * nq[j]
                    s = np.where(length == 0, 0.0, s / np.where(length == 0, 1, length))
            if mixed:
                s = np.where((wu[i] != wq[j]) | (wu[i] < 0), 0.0, s)
            got[lo : lo + PAIRS] = s if digits is None else half_up(s, digits)
        return got

    out = []
    for lo in range(0, len(q), TILE_QUERIES):
        part = slice(lo, min(lo + TILE_QUERIES, len(q)))
        n = part.stop - lo
        floor = np.full(n, -np.inf)
        kept = none
        for at in range(0, len(u), TILE_ROWS):
            tile = slice(at, min(at + TILE_ROWS, len(u)))
            near = near_u[tile] @ near_q[part].T
            if mixed:
                near[(wu[tile, None] != wq[None, part]) | (wu[tile, None] < 0)] = 0
            odd = odd_u[tile, None] | odd_q[None, part] if odd_u[tile].any() or odd_q[part].any() else None
            if at == 0 and len(near) >= k + own_rows:
                sure = near if odd is None else np.where(odd, -np.inf, near)
                if cu is not None:
                    sure = np.where((cu[tile, None, :] == codes[1][None, part, :]).any(2), sure, -np.inf)
                floor = np.partition(sure, len(near) - k - own_rows, 0)[len(near) - k - own_rows]
            if odd is not None:
                near[odd] = np.inf
            i, j = np.nonzero(near >= floor - slack)
            if cu is not None:
                shared = (cu[i + at] == codes[1][j + lo]).any(1)
                i, j = i[shared], j[shared]
            if not len(i):
                continue
            s = exact(i + at, j + lo)
            each = begin[i + at + 1] - begin[i + at]
            row = members[np.repeat(begin[i + at] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())]
            j, s = np.repeat(j, each), np.repeat(s, each)
            other = ids[row] != qids[j + lo]
            j, row, s = np.r_[kept[0], j[other]], np.r_[kept[1], row[other]], np.r_[kept[2], s[other]]
            best = _first_k(j, s, ids[row], k)
            kept = j[best], row[best], s[best]
            full = np.bincount(kept[0], minlength=n) >= k
            least = np.full(n, np.inf)
            np.minimum.at(least, kept[0], _order(kept[2]))
            floor = np.where(full, np.maximum(floor, least), floor)
        out.append((kept[0] + lo, kept[1], kept[2]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_pairs(queries: DataFrame, rows: DataFrame, keys: Sequence[str], k: int, blocks: int = 1, unit: bool = False, digits: int | None = 6) -> DataFrame:
    """(query_id, id, score and ``keys``): of each query (query_id, q, ``keys``) the best
    ``k`` rows (id, v, ``keys``) within each group of equal keys. ``blocks``: how many
    parts the queries are dealt in. ``unit``: lengths are taken as 1. ``digits``: scores
    are rounded before they are compared."""
    queries, rows = (df.dropna(subset=[c, *keys]) for df, c in ((queries, "query_id"), (rows, "id")))
    queries = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = [queries.schema["query_id"], rows.schema["id"], StructField("score", DoubleType()), *(queries.schema[c] for c in keys)]
    by = [*keys, "_block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        j, i, score = best_of_group(left, right, k, unit, digits)
        cols = [right["query_id"].take(pa.array(j)), left["id"].take(pa.array(i)), pa.array(score), *(right[c].take(pa.array(j)) for c in keys)]
        return pa.table(cols, names=["query_id", "id", "score", *keys])

    return rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(run, StructType(fields))


def nearest(queries: DataFrame, rows: DataFrame, k: int, keys: Sequence[str] = (), limit: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): cosine, rounded to six digits, of the best ``k`` rows
    (id, v, ``keys`` and perhaps codes) of each query (query_id, q, ``keys``) with equal
    keys. Rows are dealt in parts of about ``PART_ROWS``, queries in blocks of about
    ``limit``; each block of queries meets each part of its keys once."""
    keys = list(keys)
    blocks = max(1, -(-queries.count() // limit))
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")).filter("_parts > 0")
    if keys:
        queries, rows = queries.join(parts, keys), rows.join(parts, keys)
    else:
        n = max(1, (parts.first() or [1])[0])
        queries, rows = queries.withColumn("_parts", F.lit(n)), rows.withColumn("_parts", F.lit(n))
    queries = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    found = best_pairs(queries, rows, [*keys, "_part"], k, blocks).select("query_id", "id", "score")
    return best(found, k)


def best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
