"""Components, cycles and dependency levels of graphs against brute force, and deep ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import hierarchy


def reach(edges):
    ahead, out = {}, {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[s] = seen
    return out


def brute_components(edges):
    to = reach(edges)
    return {v: min(u for u in to[v] if v in to[u]) for v in to if v in to[v]}


def brute_cycles(edges):
    owner, out = brute_components(edges), {}
    for start in set(owner.values()):
        ways = [(start,)]
        while True:
            ways = sorted((*w, b) for w in ways for a, b in set(edges) if a == w[-1])
            done = [w for w in ways if w[-1] == start]
            if done:
                out[">".join(map(str, done[0]))] = len(done[0]) - 1
                break
            best = {}
            for w in ways:
                best.setdefault(w[-1], w)
            ways = list(best.values())
    return out


def brute_levels(edges):
    edges, level = set(edges), {}
    for v in {b for _, b in edges} - {a for a, _ in edges}:
        level[v] = 0
    while True:
        new = {a: max(level[b] for x, b in edges if x == a) + 1 for a in {a for a, _ in edges} - set(level) if all(b in level for x, b in edges if x == a)}
        if not new:
            return level
        level |= new


def graph(seed):
    rng = random.Random(seed)
    n = 26
    if seed == 0:  # two rings, a chain between, a tail before and after, and loops
        edges = [(k, (k + 1) % 6) for k in range(6)] + [(10 + k, 10 + (k + 1) % 5) for k in range(5)] + [(3, 7), (7, 8), (8, 12), (20, 21), (21, 0), (14, 22), (22, 23), (23, 23), (24, 24)]
    elif seed == 1:  # many ways
        edges = [(k, (k * j + j) % n) for k in range(n) for j in (2, 3, 7)]
    else:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([15, 24, 30, 45]))]
    return edges + edges[:3]


@pytest.mark.parametrize("seed", range(4))
def test_components_and_cycles_equal_brute_force(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src int, dst int")
    assert {r.node: r.component for r in hierarchy.cyclic_components(df).collect()} == brute_components(edges)
    assert {r.cycle: r.length for r in hierarchy.cycles(df).collect()} == brute_cycles(edges)


@pytest.mark.parametrize("seed", [0, 2, 5, 6])
def test_levels_equal_brute_force(spark, seed):
    edges = graph(seed) if seed < 5 else [(max(a, b), min(a, b)) for a, b in graph(seed) if a != b]
    got = {r.node: r.level for r in hierarchy.levels(spark.createDataFrame(edges, "metric int, input int")).collect()}
    assert got == brute_levels(edges)


def test_a_ring_and_a_chain_of_ten_thousand(spark):
    n, began = 10_000, time.time()
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    r = hierarchy.cycles(ring).collect()
    assert len(r) == 1 and r[0].length == n and r[0].cycle.startswith("0>1>2>") and r[0].cycle.endswith(">9999>0")
    chain = spark.range(1, n + 1).select(F.col("id").alias("metric"), (F.col("id") - 1).alias("input"))
    assert hierarchy.levels(chain).filter("node = level").count() == n + 1
    assert time.time() - began < 120


def test_a_dense_graph_of_ten_thousand_nodes(spark):
    n, began = 10_000, time.time()
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select("src", F.pmod(F.col("src") * (2 * F.col("k") + 1) + F.col("k") * F.col("k"), F.lit(n)).alias("dst"))
    members = hierarchy.cyclic_components(edges)
    assert members.select("component").distinct().count() >= 1 and members.count() > n / 2
    assert time.time() - began < 180


def test_no_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert hierarchy.cycles(none).count() == hierarchy.cyclic_components(none).count() == 0
    assert hierarchy.levels(spark.createDataFrame([], "metric int, input int")).count() == 0
