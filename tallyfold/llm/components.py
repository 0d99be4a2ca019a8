"""Connected components of an edge table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); a component is named by its
    smallest id. Null ends and self loops are ignored; no edges give no rows.

    Alternating large-star and small-star steps: every node hands its smallest
    neighbour to the larger, then to the smaller ones, until nothing changes. Rounds
    grow with the logarithm of the nodes. A step is a minimum (combined before its
    shuffle) joined back to the edges, so a node with many neighbours is never gathered
    into one value, and a join may split its edges.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        leads = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.join(leads, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        step = small.select(F.col("m").alias("a"), "b").unionByName(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        step = materialize(step, "edges")
        # stars already: nobody has two leads, and no lead is led
        led = step.groupBy("b").agg(F.count("*").alias("n"))
        done = led.filter("n > 1").isEmpty() and step.join(led.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        edges = step
        if done:
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
