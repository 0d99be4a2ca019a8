"""Filter interaction audit: what each filter removes in every order of applying them.

Failing-id relations: each filter has one table of the rows that fail it, bucketed by row.
Prefixes of orders matter only as sets, so the survivors of all 32 sets are computed once:
filter by filter, every set so far is kept as it is and, by a left-anti join with the
filter's table, extended by that filter; a left-semi join gives what it loses there. At
the end each filter's table meets the survivors of the sets without it (left-semi: its
removals and their labels) and the rows lost by them (left-semi: its redundancies). All
these joins are on the row number over tables bucketed by it, so after the first writes
nothing is shuffled but counts. Rows that fail no filter take no part in the joins; they
survive everything and are counted.

Results on odd input: a null text is the empty text, a null source the empty string; a row
without an id is nobody's copy and has no labels; rows that share an id are counted each,
and are no copies of each other; of several labels of an id each one counts (good if any
row says so, toxic likewise); texts of any length are read whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, scratch_path, table

FILTERS = "ABCDE"
BUCKET_ROWS = 1_000_000
LEAST_WORDS, DISTINCT_PCT, CAPITALS_PCT = 50, 65, 5
CAPITALS, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions that a text decides by itself: A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PCT,
        "C": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * 100 > F.length(text) * CAPITALS_PCT,
        "D": text.rlike(SIGNS),
    }


def read(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The written rows (row, part, good, toxic) and each filter's failing rows (row)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"), *(c.alias(f) for f, c in text_failures(text).items())
    )
    found = materialize(found, "failures")
    owner = found.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").select("print", "first")
    owner = materialize(owner, "owners")  # so that the join below is between tables, and a text of very many copies may be split in it
    fails = {f: found.filter(f).select("row") for f in "ABCD"}
    fails["E"] = found.select("row", "doc_id", "print").join(owner, "print").filter("doc_id > first").select("row")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = found.select("row", "doc_id", "part").join(marks, "doc_id", "left").select("row", "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    return rows, fails


class Relations:
    """Tables bucketed by row in the shared folder, named in the session's catalog until ``close``."""

    def __init__(self, spark: SparkSession, n_rows: int) -> None:
        self.spark, self.names = spark, []
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // BUCKET_ROWS))

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        name = f"audit_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "row").write.bucketBy(self.buckets, "row").sortBy("row").option("path", scratch_path(self.spark, tag)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table {name}")


def audit(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """part, before (bit set of filters applied), filter, kept, removed, redundant,
    good_lost, toxic_lost for every part, filter and set of other filters, zeros included.
    ``rows``: (row, part, good, toxic), row being unique; ``fails``: a table (row) for each
    filter."""
    spark, names = rows.sparkSession, list(fails)
    rows = materialize(rows, "rows")
    made = Relations(spark, rows.count())
    try:
        fails = {f: made.write(d, f"fails-{f}") for f, d in fails.items()}
        some = fails[names[0]]
        for f in names[1:]:
            some = some.unionByName(fails[f])
        touched = made.write(rows.join(some.distinct(), "row", "left_semi"), "touched")
        left, lost = touched.withColumn("applied", F.lit(0)), []
        for i, f in enumerate(names):
            # lost here, and so by every set that goes on from here with later filters
            later = [sum(x) for n in range(len(names) - i) for x in itertools.combinations([1 << j for j in range(i + 1, len(names))], n)]
            gone = left.join(fails[f], "row", "left_semi").withColumn("later", F.explode(F.array(*map(F.lit, later))))
            lost.append(gone.withColumn("applied", F.col("applied") + (1 << i) + F.col("later")).select("row", "part", "applied"))
            both = left.withColumn("now", F.explode(F.array(F.lit(0), F.lit(1 << i))))
            ids = fails[f].withColumnRenamed("row", "failing")
            left = both.join(ids, (F.col("row") == F.col("failing")) & (F.col("now") > 0), "left_anti")
            left = made.write(left.select("row", "part", "good", "toxic", (F.col("applied") + F.col("now")).alias("applied")), "left")
        gone = lost[0]
        for d in lost[1:]:
            gone = gone.unionByName(d)
        gone = made.write(gone, "gone")

        sets = range(1 << len(names))
        grid = [(s, i) for s in sets for i in range(len(names)) if not s >> i & 1]
        slots = lambda pairs: F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(i).alias("f")) for s, i in pairs)))
        measures = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
        wide = lambda d, **given: d.select("part", "before", "f", *(given.get(m, F.lit(0)).cast("long").alias(m) for m in measures))
        # rows that fail nothing are kept by every set
        clean = rows.join(touched.select("row"), "row", "left_anti").groupBy("part").agg(F.count("*").alias("n"))
        zero = rows.select("part").distinct().withColumn("n", F.lit(0).cast("long"))
        everywhere = clean.unionByName(zero).withColumn("s", slots(grid)).select("part", "s.*", "n")
        counts = [wide(everywhere, kept=F.col("n"))]
        kept = left.groupBy("part", "applied").agg(F.count("*").alias("n"))
        last = kept.withColumn("f", F.explode(F.array(*(F.lit(i) for i in range(len(names)))))).withColumn("bit", F.expr("shiftleft(1, f)"))
        counts.append(wide(last.filter("applied & bit <> 0").withColumn("before", F.col("applied") - F.col("bit")), kept=F.col("n")))
        for i, f in enumerate(names):
            without = lambda d, i=i, f=f: d.filter(F.col("applied").bitwiseAND(1 << i) == 0).join(fails[f], "row", "left_semi").withColumn("f", F.lit(i)).groupBy("part", F.col("applied").alias("before"), "f")
            counts.append(wide(without(left).agg(F.count("*").alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t")), removed=F.col("n"), good_lost=F.col("g"), toxic_lost=F.col("t")))
            counts.append(wide(without(gone).agg(F.count("*").alias("n")), redundant=F.col("n")))
        out = counts[0]
        for d in counts[1:]:
            out = out.unionByName(d)
        named = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1)
        out = out.groupBy("part", "before", "f").agg(*(F.sum(m).alias(m) for m in measures))
        return materialize(out.select("part", "before", named.alias("filter"), *measures), "audit")
    finally:
        made.close()


def by_order(found: DataFrame, names: str = FILTERS) -> DataFrame:
    """``audit``'s sets spelled out: a row per part, order of the filters and step."""
    n = len(names)
    steps = [("".join(order), k + 1, order[k], sum(1 << names.index(f) for f in order[:k])) for order in itertools.permutations(names) for k in range(n)]
    orders = found.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    size = F.bit_count("before")
    times = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), (size + 1).cast("int"))
    own = W.partitionBy("part", "filter")
    found = found.withColumn("shapley", F.sum(F.col("removed") * times).over(own)).withColumn("unique_fails", F.max(F.when(size == n - 1, F.col("removed"))).over(own))
    # the orders are a fixed table of 600 rows
    return found.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_order(audit(*read(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))))


OP13_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    row_number() over () as r
  from documents
), m as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id
), f as (
  select r, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 50)::int as a, (100 * len(list_distinct(w)) < 65 * len(w))::int as b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int as c, regexp_matches(t, '[#$%&*|]')::int as d,
    (d.doc_id is not null and d.doc_id > min(d.doc_id) over (partition by t))::int as e
  from d left join m on d.doc_id = m.doc_id
), g as (
  select part, a + 2 * b + 4 * c + 8 * d + 16 * e as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), l(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from l a join l b on a.x <> b.x join l c on c.x not in (a.x, b.x) join l d on d.x not in (a.x, b.x, c.x) join l e on e.x not in (a.x, b.x, c.x, d.x)
), s as (
  select filter_order, k::int as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::int as before from o, unnest([1, 2, 3, 4, 5]) as u(k)
), v as (
  select part, filter_order, step, bit, coalesce(sum(n) filter ((fails & (before | bit)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (fails & bit <> 0 and fails & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (fails & bit <> 0 and fails & before <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails & bit <> 0 and fails & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails & bit <> 0 and fails & before = 0), 0)::bigint as toxic_lost
  from g, s group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from v
"""
