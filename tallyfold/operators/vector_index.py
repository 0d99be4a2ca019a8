"""K7. Inverted-file index of vectors: written once, then searched list by list.

Centroids come from k-means on a bounded sample of the vectors; every vector goes to the
list of its nearest centroid and is written below ``lists/list=<n>``. Lists larger than
``PART_ROWS`` are dealt in parts, so no list, however many copies of a vector it holds, is
the work of one task. Beside them ``centroids`` has each list's centroid, its rows, its
parts and its radius, the largest angle between the centroid and a vector of the list, as
a versioned table that is written last: a folder without it is no index.

A search reads the lists of the nearest centroids of each query and ranks their vectors by
exact cosine; ``tuned`` tells how many lists a wanted recall takes. ``search_exact`` then reads those further lists that could hold something
better: a vector of a list with radius r, whose centroid is at angle t from the query, is
at t - r or further.

Vectors that are null, hold nulls or non-finite numbers, or have length 0 are not indexed
and are no queries; all others have the same width. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tallyfold.operators.vector_blocks import QUERY_BLOCK, best, best_pairs, matrix, norms, width_of
from tallyfold.sources.scratch import materialize
from tallyfold.sources.tables import read_newest, write_version

LISTS, SAMPLE, PART_ROWS, PROBES = 100, 50_000, 32_768, 16
SLACK = 1e-6  # radians by which a list may be nearer than its rounded radius says


def unit(vectors: DataFrame) -> DataFrame:
    """The usable vectors as (id, u): doubles of length 1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, widths = matrix(b["v"], width_of(b["v"]))
            with np.errstate(all="ignore"):
                length = norms(x)
                keep = np.flatnonzero((widths > 0) & np.isfinite(x).all(1) & (length > 0))
                u = x[keep] / length[keep, None]
            offsets = np.r_[0, np.cumsum(widths[keep])].astype(np.int32)
            flat = u[np.arange(u.shape[1]) < widths[keep, None]]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "u"])

    return vectors.select("id", "v").mapInArrow(run, StructType([vectors.schema["id"], StructField("u", ArrayType(DoubleType()))]))


def farthest(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """(list, rows, radius): rows and largest angle to the centroid, of ``assigned`` (u, list)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u, _ = matrix(b["u"], centres.shape[1])
            at = np.array(b["list"])
            angle = np.arccos(np.clip((u * centres[at]).sum(1), -1, 1))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, at, angle)
            lists = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(np.bincount(at, minlength=len(centres))[lists]), pa.array(radius[lists])], names=["list", "rows", "radius"])

    return assigned.select("u", "list").mapInArrow(run, "list int, rows long, radius double").groupBy("list").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))


class InvertedFile:
    """An index that was written by ``build``. Its centroids, one vector a list, are held
    by the driver and sent to the tasks; their number is a parameter of ``build``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(read_newest(spark, f"{self.path}/centroids").collect(), key=lambda r: r["list"])
        self.lists = [r["list"] for r in rows]
        self.parts = {r["list"]: r["parts"] for r in rows}
        self.radius = np.array([r["radius"] for r in rows])
        self.centroids = np.array([r["centroid"] for r in rows])

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, seed: int = 1) -> InvertedFile:
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = materialize(unit(vectors), "unit").withColumn("f", array_to_vector("u"))
        n = rows.count()
        share = min(1.0, sample / max(n, 1))
        some = rows.filter(F.pmod(F.xxhash64("id", "u"), F.lit(1_000_000)) < share * 1_000_000)
        if n == 0:
            assigned = rows.select("id", "u", F.lit(0).alias("list"))
            centres = [[0.0]]
        else:
            some = materialize(some.drop("f"), "sample").withColumn("f", array_to_vector("u"))
            some = some if some.count() else rows.limit(sample)
            k = max(2, min(lists, some.count() // 8))
            model = KMeans(k=k, featuresCol="f", predictionCol="list", distanceMeasure="cosine", maxIter=12, seed=seed).fit(some)
            assigned = model.transform(rows).select("id", "u", "list")
            centres = [(c / max(np.linalg.norm(c), 1e-12)).tolist() for c in model.clusterCenters()]
        assigned = materialize(assigned, "assigned")
        schema = StructType([StructField("list", IntegerType()), StructField("centroid", ArrayType(DoubleType()))])
        centre = F.broadcast(spark.createDataFrame(list(enumerate(centres)), schema))
        about = farthest(assigned, np.array(centres))
        about = about.withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int")).join(centre, "list").select("list", "centroid", "rows", "parts", "radius")
        about = materialize(about, "lists")
        out = assigned.join(F.broadcast(about.select("list", "parts")), "list")
        out = out.select("id", "u", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        out.repartition("list", "part").sortWithinPartitions("list", "part", "id").write.partitionBy("list").parquet(f"{path}/lists")
        write_version(about.coalesce(1), f"{path}/centroids")
        return cls(spark, path)

    def _to_lists(self, queries: DataFrame, probes: int, further: bool) -> DataFrame:
        """``queries`` (id, u and, if ``further``, floor) with the lists and parts to read:
        the nearest, or those besides that could hold a score of at least the floor."""
        lists, centroids, radius, parts = np.array(self.lists), self.centroids, self.radius, self.parts

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for lo in range(0, batch.num_rows, 1000):
                    b = batch.slice(lo, 1000)
                    if not b.num_rows or not len(lists):
                        continue
                    q = np.array(b["u"].to_pylist())
                    near = np.clip(q @ centroids.T, -1, 1)
                    order = np.argsort(-near, 1, kind="stable")
                    chosen = np.zeros(near.shape, bool)
                    np.put_along_axis(chosen, order[:, :probes], True, 1)
                    if further:
                        best = np.cos(np.maximum(0, np.arccos(near) - radius - SLACK))
                        chosen = ~chosen & (best >= np.array(b["floor"].to_pylist())[:, None] - SLACK)
                    at, to = np.nonzero(chosen)
                    each = np.array([parts[x] for x in lists[to].tolist()], np.int64)
                    at, to = np.repeat(at, each), np.repeat(to, each)
                    part = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                    rows = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([rows["id"], rows["u"], pa.array(lists[to], pa.int32()), pa.array(part, pa.int32())], names=["query_id", "q", "list", "part"])

        fields = {f.name: f for f in queries.schema.fields}
        schema = StructType([StructField("query_id", fields["id"].dataType), StructField("q", fields["u"].dataType), StructField("list", IntegerType()), StructField("part", IntegerType())])
        return queries.mapInArrow(run, schema)

    def _score(self, asked: DataFrame, k: int, queries: int) -> DataFrame:
        """The best ``k`` of each list and part that a query goes to, ``queries`` in all;
        only these lists are read."""
        asked = materialize(asked, "asked")
        lists = [r[0] for r in asked.select("list").distinct().collect()]
        stored = self._stored(asked.schema["query_id"].dataType.simpleString()).filter(F.col("list").isNotNull() & F.col("list").isin(lists))
        blocks = max(1, -(-queries // QUERY_BLOCK))
        return best_pairs(asked, stored.withColumnRenamed("u", "v"), ["list", "part"], k, blocks, unit=True, digits=None).drop("part")

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"id {kind}, u array<double>, part int, list int").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(query_id, id, score, rank) of the best ``k`` in the ``probes`` nearest lists of
        each query (id, v); a query is no hit of itself."""
        asked = materialize(unit(queries), "queries")
        return best(self._score(self._to_lists(asked, probes, False), k, asked.count()), k).drop("list")

    def search_exact(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """As ``search``, but of all vectors."""
        return self._exact(unit(queries), k, probes).drop("list")

    def _exact(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        asked = materialize(asked, "queries")
        n = asked.count()
        first = materialize(best(self._score(self._to_lists(asked, probes, False), k, n), k), "first")
        floor = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        asked = asked.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        rest = self._score(self._to_lists(asked, probes, True), k, n)
        return best(first.drop("rank").unionByName(rest), k)

    def tuned(self, k: int, recall: float = 0.95, sample: int = 200, kind: str = "long") -> int:
        """The number of nearest lists that hold this share of the true best ``k``, by exact
        search for about ``sample`` of the indexed vectors. ``kind``: the type of the ids."""
        stored = self._stored(kind)
        share = min(1.0, sample / max(1, stored.count()))
        some = materialize(stored.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000).select("id", "u").limit(4 * sample), "sample")
        asked = {r["id"]: r["u"] for r in some.collect()}
        at = []
        for r in self._exact(some, k, 1).select("query_id", "list").collect():
            near = self.centroids @ np.array(asked[r["query_id"]])
            at.append(int((near > near[self.lists.index(r["list"])]).sum()) + 1)
        return int(np.quantile(at, recall, method="higher")) if at else PROBES

    def add(self, vectors: DataFrame) -> None:
        """More vectors, to the lists of the centroids there are. Radii grow with them and
        are written first, so a search meanwhile may read a list in vain, but misses none."""
        lists, centroids = np.array(self.lists), self.centroids

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                u = np.array(b["u"].to_pylist()).reshape(b.num_rows, -1)
                near = np.clip(u @ centroids.T, -1, 1) if b.num_rows else np.empty((0, 1))
                to = near.argmax(1)
                yield pa.RecordBatch.from_arrays([b["id"], b["u"], pa.array(lists[to], pa.int32()), pa.array(np.arccos(near[np.arange(len(to)), to]))], names=["id", "u", "list", "angle"])

        rows = unit(vectors)
        rows = materialize(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("angle", DoubleType())])), "added")
        wider = {r["list"]: r for r in rows.groupBy("list").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}
        about = read_newest(self.spark, f"{self.path}/centroids")
        grown = self.spark.createDataFrame([(x, float(r["angle"]), r["n"]) for x, r in wider.items()], "list int, angle double, n long")
        about = about.join(F.broadcast(grown), "list", "left").select("list", "centroid", (F.col("rows") + F.coalesce("n", F.lit(0))).alias("rows"), "parts", F.greatest("radius", "angle").alias("radius"))
        write_version(about.coalesce(1), f"{self.path}/centroids")
        parts = self.spark.createDataFrame(list(self.parts.items()), "list int, parts int")
        out = rows.join(F.broadcast(parts), "list").select("id", "u", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        out.repartition("list", "part").sortWithinPartitions("list", "part", "id").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        self.__init__(self.spark, self.path)
