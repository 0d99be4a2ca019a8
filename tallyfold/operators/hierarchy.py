"""Metric hierarchies and dependency graphs as node and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked
from tallyfold.sources.scratch import materialize, scratch_path


def with_children(nodes: DataFrame) -> DataFrame:
    """C18. Each node's number of children and of siblings, and its first children."""
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"), F.min("pos").alias("first_child_pos"))
    same = nodes.groupBy("parent").agg((F.count("*") - 1).alias("siblings")).withColumnRenamed("parent", "p")
    j = nodes.join(kids, "id", "left").join(same, nodes["parent"].eqNullSafe(same["p"]), "left").drop("p")
    return j.select("id", "parent", F.coalesce("children", F.lit(0)).cast("long").alias("children"), "siblings", "first_child_pos")


def roots(nodes: DataFrame) -> DataFrame:
    """L1. Nodes whose parent is null or not in the table."""
    return nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select(*nodes.columns)


def children(nodes: DataFrame, parent: str) -> DataFrame:
    """L1. A node's children by position."""
    return nodes.filter(F.col("parent") == parent).orderBy("pos", "id")


def siblings(nodes: DataFrame, id: str) -> DataFrame:
    """L1. The other children of a node's parent, or the other roots, by position."""
    mine = nodes.filter(F.col("id") == id).select(F.col("parent").alias("p")).limit(1)
    return nodes.join(F.broadcast(mine), nodes["parent"].eqNullSafe(F.col("p")), "left_semi").filter(F.col("id") != id).orderBy("pos", "id")


def by_statement(nodes: DataFrame, statement: str) -> DataFrame:
    """L1. Nodes of a statement, whatever its case, by level and position."""
    return nodes.filter(F.lower("statement_type") == statement.lower()).orderBy("level", "pos", "id")


def by_level(nodes: DataFrame, level: int) -> DataFrame:
    """L1."""
    return nodes.filter(F.col("level") == level).orderBy("pos", "id")


def rollup(nodes: DataFrame) -> DataFrame:
    """D26. Sum of direct children against the node's own value."""
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("child_sum"), F.count("*").alias("children"))
    j = nodes.join(kids, "id").withColumn("variance", F.round(F.col("value") - F.col("child_sum"), 2))
    pct = F.when(F.col("value") == 0, 0.0).otherwise(F.round(F.abs("variance") / F.abs("value") * 100, 6))
    return j.select("id", "value", "child_sum", "children", "variance", pct.alias("variance_pct"))


def rollup_errors(nodes: DataFrame, tolerance_pct: float) -> DataFrame:
    """F8."""
    return rollup(nodes).filter(F.col("variance_pct") > tolerance_pct).orderBy(F.desc("variance_pct"), "id")


def key_drivers(nodes: DataFrame, n: int) -> DataFrame:
    """E31. Largest children of each parent with their share of it."""
    parents = nodes.select(F.col("id").alias("parent"), F.col("value").alias("parent_value"))
    top = ranked(nodes.filter("parent is not null"), ["parent"], F.desc(F.abs("value")), "id", top=n).join(parents, "parent")
    share = F.round(F.col("value") / F.nullif(F.col("parent_value"), F.lit(0.0)) * 100, 6)
    return top.select("parent", "id", "value", share.alias("contribution_pct"))


def _walked(nodes: DataFrame, first: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, acc) of every node that reaches a root (a null parent): ``first`` of each node
    on its way from the root, merged in that order. Every round joins the nodes with
    themselves and doubles how far each one sees, so depth costs its logarithm; nodes on
    or below a cycle, or below a parent that is not there, reach no root."""
    state = materialize(nodes.select("id", F.col("parent").alias("up"), first.alias("acc")), "walk")
    done, active = state.filter("up is null"), state.filter("up is not null")
    for _ in range(max(1, int(state.count()).bit_length())):
        if active.isEmpty():
            break
        above = done.unionByName(active).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("acc").alias("acc2"))
        step = materialize(active.join(above, "up").select("id", F.col("up2").alias("up"), merge(F.col("acc2"), F.col("acc")).alias("acc")), "walk")
        done, active = done.unionByName(step.filter("up is null")), step.filter("up is not null")
    return done.select("id", "acc")


def paths(nodes: DataFrame) -> DataFrame:
    """L2. Path from the root to every node."""
    walked = _walked(nodes, F.array(F.col("id").cast("string")), F.concat)
    return walked.select("id", F.array_join("acc", "/").alias("path"), (F.size("acc") - 1).alias("depth"))


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """L3. A node and what is below it, in pre-order by position."""
    mine = nodes.withColumn("parent", F.when(F.col("id") != root, F.col("parent"))).filter(F.col("parent").isNotNull() | (F.col("id") == root))
    walked = _walked(mine, F.array("pos"), F.concat)
    return walked.orderBy("acc", "id").select("id", (F.size("acc") - 1).alias("depth"))


def ordered(nodes: DataFrame) -> DataFrame:
    """L7. All nodes with a sort key that gives the pre-order, and their indent."""
    walked = _walked(nodes, F.array(F.lpad(F.col("pos").cast("string"), 12, "0")), F.concat)
    return walked.select("id", F.array_join("acc", ".").alias("sort_key"), (F.size("acc") - 1).alias("indent"))


def max_depth(nodes: DataFrame) -> DataFrame:
    """L4."""
    return _walked(nodes, F.lit(1), lambda above, own: above + own).agg((F.max("acc") - 1).alias("max_depth"))


def _jumps(pointers: DataFrame) -> list[DataFrame]:
    """Pointer doubling over (node, to) and, if steps differ in length, hops, one row a
    node: tables (node, to, hops, low, ended) of one step, two, four and so on, the last of
    at least as many steps as there are nodes. ``ended``: ``to`` has no pointer, and the way there may be shorter; ``low``:
    the least node on the way, without ``to``."""
    on = pointers.select(F.col("node").alias("to"), F.lit(False).alias("ended"))
    hops = F.col("hops") if "hops" in pointers.columns else F.lit(1)
    first = pointers.join(on, "to", "left").select("node", "to", hops.cast("long").alias("hops"), F.col("node").alias("low"), F.coalesce("ended", F.lit(True)).alias("ended"))
    tables = [materialize(first, "jumps")]
    for _ in range(int(tables[0].count()).bit_length()):
        now = tables[-1]
        active = now.filter("not ended")
        if active.isEmpty():
            break
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("ended").alias("ended2"))
        step = active.drop("ended").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("low", "low2").alias("low"), F.col("ended2").alias("ended"))
        tables.append(materialize(now.filter("ended").unionByName(step), "jumps"))
    return tables


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _connected(edges: DataFrame, dense: bool = False) -> DataFrame:
    """(node, label) of every node on a cycle; nodes share a label if each leads to the other.

    Nodes with one way on are followed to where ways part, by pointer doubling, so chains,
    trees and rings cost the logarithm of their length; what is left is done likewise
    against the arrows, and so on. When neither way shrinks it, every node has two ways in
    and two out: the least label is passed on until nothing changes, and whatever leads
    back to a node of its own label is that node's component.
    """
    edges = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    # an edge into a node without ways on is on no cycle
    ways = edges.filter("src <> dst")
    ways = materialize(ways.join(ways.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
    if ways.isEmpty():
        return loops.withColumn("label", F.col("node"))
    out = ways.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    single = materialize(out.filter("n = 1").select(F.col("src").alias("node"), F.col("dst").alias("to")), "single")
    if single.isEmpty():
        trimmed = ways.count() < edges.count()
        labels = _coloured(ways) if dense and not trimmed else _connected(_flipped(ways), dense=not trimmed)
    else:
        tables = _jumps(single)
        end = tables[-1]
        ring = materialize(end.filter("not ended").select(F.col("to").alias("node")).distinct().join(end.select("node", F.col("low").alias("label")), "node"), "rings")
        # ways that part, and where each of them leads
        goal = end.filter("ended").select(F.col("node").alias("dst"), F.col("to").alias("goal"))
        entries = ways.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(goal, "dst", "left")
        lost = end.filter("not ended").select(F.col("node").alias("dst"))
        entries = materialize(entries.join(lost, "dst", "left_anti").select("src", "dst", F.coalesce("goal", "dst").alias("goal")), "entries")
        labels = materialize(_connected(_flipped(entries.select("src", F.col("goal").alias("dst")))), "labels")
        # a node with one way on belongs to its goal's component if a member leads to it
        inside = entries.filter("dst <> goal").join(labels.withColumnRenamed("node", "src"), "src")
        inside = inside.join(labels.select(F.col("node").alias("goal"), F.col("label").alias("own")), "goal").filter("label = own")
        marked = inside.select(F.col("dst").alias("node"), "label").distinct()
        for table in tables:
            ahead = marked.join(table.filter("not ended").select("node", "to"), "node").select(F.col("to").alias("node"), "label")
            marked = materialize(marked.unionByName(ahead).distinct(), "marked")
        labels = labels.unionByName(marked).unionByName(ring)
    return labels.unionByName(loops.join(labels, "node", "left_anti").withColumn("label", F.col("node")))


def _coloured(ways: DataFrame) -> DataFrame:
    """As ``_connected``, for a graph of many ways."""
    colour = materialize(ways.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "colours")
    while True:
        got = ways.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("least"))
        step = materialize(colour.join(got, "node", "left").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("changed")), "colours")
        colour = step.select("node", "label")
        if step.filter("changed").isEmpty():
            break
    of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    within = materialize(ways.join(of("src"), "src").join(of("dst"), "dst").filter("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")), "edges")
    member = last = materialize(colour.filter("node = label"), "members")
    while True:
        back = within.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "label").distinct()
        last = materialize(back.join(member, "node", "left_anti"), "members")
        if last.isEmpty():
            break
        member = materialize(member.unionByName(last), "members")
    is_one = lambda end: member.select(F.col("node").alias(end))
    rest = within.join(is_one("src"), "src", "left_anti").join(is_one("dst"), "dst", "left_anti").select("src", "dst")
    # a root alone, without a way back to itself, is on no cycle
    found = member.join(member.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label").select("node", "label")
    return found.unionByName(_connected(rest))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """L5. (node, component) of every node of (src, dst) that is on a cycle: nodes that lead
    to each other share the component, which is named by its least node."""
    labels = materialize(_connected(edges), "components")
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """L5. For each component of ``cyclic_components`` a shortest cycle through its least
    node (of several the first by its nodes). A component that is one ring is ordered by
    pointer doubling; in others each wave of joins goes one node further from the least
    one, within the component, and keeps one way to each node."""
    edges = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    member = materialize(cyclic_components(edges), "members")
    of = lambda end: member.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    own = edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_in = dst_in").select(F.col("src_in").alias("start"), "src", "dst")
    own = materialize(own, "own")
    size = own.groupBy("start").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("nodes"))
    rings, other = own.join(size.filter("edges = nodes"), "start", "left_semi"), materialize(own.join(size.filter("edges > nodes"), "start", "left_semi"), "other")
    # a ring is cut at its least node; the further a node is from there, the earlier it comes
    to = _jumps(rings.filter("src <> start").select(F.col("src").alias("node"), F.col("dst").alias("to")))[-1]
    placed = rings.filter("src <> start").select("start", F.col("src").alias("node")).join(to.select("node", "hops"), "node")
    placed = placed.unionByName(rings.select("start", F.col("start").alias("node")).distinct().withColumn("hops", F.lit(2**62).cast("long")))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "node")))
    found = placed.groupBy("start").agg(F.transform(in_order, lambda x: x["node"]).alias("way")).select("way")
    reach = last = materialize(other.filter("src = start").select("start", F.col("dst").alias("node"), F.when(F.col("dst") == F.col("start"), F.array("src")).otherwise(F.array("src", "dst")).alias("way")), "reach")
    while not last.isEmpty():
        closed = materialize(last.filter("node = start").groupBy("start").agg(F.min("way").alias("way")), "cycles")
        found = found.unionByName(closed.select("way"))
        open_ = last.join(closed.select("start"), "start", "left_anti")
        step = open_.join(other.withColumnRenamed("src", "node"), ["start", "node"]).select("start", F.col("dst").alias("node"), F.when(F.col("dst") == F.col("start"), F.col("way")).otherwise(F.concat("way", F.array("dst"))).alias("way"))
        step = step.join(reach.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("way").alias("way"))
        last = materialize(step, "reach")
        reach = materialize(reach.select("start", "node").unionByName(last.select("start", "node")), "reached")
    return found.select(F.concat_ws(">", F.col("way").cast("array<string>"), F.col("way")[0].cast("string")).alias("cycle"), F.size("way").alias("length"))


def levels(edges: DataFrame) -> DataFrame:
    """L6. Dependency level of every node of (metric, input): inputs without inputs are
    0, others one above their highest input; members of a cycle, and what needs them,
    have none.

    A metric with one input is as far above whatever that leads to as the way is long, so
    such metrics are followed down to where inputs part, by pointer doubling, and taken
    out; of the others each round places those all of whose inputs are placed. A chain or
    tree costs the logarithm of its depth, other graphs a round for each level at which
    inputs come together. What is placed is one table that grows by appending.
    """
    spark, path, followed = edges.sparkSession, scratch_path(edges.sparkSession, "levels"), []
    left = materialize(edges.select("metric", "input").distinct().withColumn("above", F.lit(1).cast("long")), "edges")
    ready = left.select(F.col("input").alias("node")).distinct().join(left.select(F.col("metric").alias("node")), "node", "left_anti").withColumn("level", F.lit(0).cast("long"))
    ready = materialize(ready, "ready")
    while True:
        ready.write.mode("append").parquet(path)
        placed = spark.read.schema(ready.schema).parquet(path)
        inputs = left.groupBy("metric").agg(F.count("*").alias("n"), F.min("input").alias("to"), F.min("above").alias("hops"))
        single = materialize(inputs.filter("n = 1").select(F.col("metric").alias("node"), "to", "hops"), "single")
        if not single.isEmpty():
            down = _jumps(single)[-1].filter("ended")
            followed.append(down)
            rest = left.join(single.select(F.col("node").alias("metric")), "metric", "left_anti")
            rest = rest.join(down.select(F.col("node").alias("input"), "to", "hops"), "input", "left")
            # inputs that lead to the same are one input now, the longer way counts
            left = rest.groupBy("metric", F.coalesce("to", "input").alias("input")).agg(F.max(F.col("above") + F.coalesce("hops", F.lit(0))).alias("above"))
            left = materialize(left, "edges")
        known = left.join(placed.withColumnRenamed("node", "input"), "input", "left")
        now = known.groupBy("metric").agg(F.max(F.col("level") + F.col("above")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = materialize(now.filter("open = 0").select(F.col("metric").alias("node"), "level"), "ready")
        if ready.isEmpty() and single.isEmpty():
            break
        left = materialize(left.join(ready.select(F.col("node").alias("metric")), "metric", "left_anti"), "edges")
    for down in reversed(followed):
        above = down.join(placed.select(F.col("node").alias("to"), "level"), "to").select("node", (F.col("level") + F.col("hops")).alias("level"))
        placed = materialize(placed.unionByName(above), "levels")
    return placed.select("node", F.col("level").cast("int").alias("level"))


def infer_formula(nodes: DataFrame, known: dict[str, str]) -> DataFrame:
    """L8. A known formula, else the sum of the children in order. A parent's formula
    names its children, so they meet in one value."""
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), " + ").alias("sum"))
    rule = F.lit(None).cast("string")
    for node, text in known.items():
        rule = F.coalesce(rule, F.when(F.col("id") == node, text))
    return kids.select("id", F.coalesce(rule, F.col("sum")).alias("formula"))


def display_order(nodes: DataFrame) -> DataFrame:
    """L1. Children of each parent numbered by position."""
    return nodes.withColumn("number", F.row_number().over(W.partitionBy("parent").orderBy("pos", "id"))).select("id", "parent", "number")
