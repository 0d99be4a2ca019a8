"""Source divergence audit: how far each source's use of terms is from the others'.

Terms are counted per (lang, source), first within each task, then by Spark. A kept term
is a row of its sources' nonzero counts, sources in a fixed order (those of few words
first: their small counts are shared most). Equal rows become one with a multiplicity;
the rows, dealt by range and sorted, are then read as a frequent-pattern tree: a node is
the beginning that a run of sorted rows shares, its multiplicity the rows' sum. The value
of a pair of sources is that of all counts zero, plus what each source's counts alone
change (from the number of terms by source and count), plus for each node and each of its
ancestors, once and times the node's multiplicity, what both counts together change. A
beginning that is cut by the end of a task is two nodes, which adds up to the same.

All numbers are integers. Counts are scaled as decimals; a value is below 2^63 as both
p and q are at most 10^9 + 1.

Results on odd input: a null text, lang or source is the empty string; a document without
terms still makes its group; a group alone in its lang has no pairs; without kept terms
pairs have the value 0; texts of any length are read whole, in parts cut between terms;
rows without an id and repeated rows count like any; ties go by the item's UTF-8 bytes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, slices, table, text_bytes

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
HELD = 400_000  # terms a task holds before it hands them on
PART = 2**22  # bytes of a text that are split at once
FEW_GROUPS = 50_000  # groups that may be broadcast; beyond, joins shuffle
CELLS = 4_000_000  # cells of a block of the tree
# letters lower-cased, all else that is no term character a blank
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_gap = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about PART bytes, cut between terms."""
    at = 0
    while at < len(raw):
        cut = _gap.search(raw, at + PART)
        end = cut.end() if cut else len(raw)
        yield raw[at:end]
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: counts and numbers of documents, in parts to be added."""
    names = ["lang", "source", "term", "n", "df"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda x, k=len(n): pa.array([x] * k, pa.string())
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=names)
            held.clear()

        for batch in slices(it, "text"):
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, df = held[lang, source]
                seen: set[bytes] = set()
                for part in _parts(text):
                    terms = part.translate(_TERMS).split()
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from handed()
        yield from handed()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def scaled(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / total), exact whatever the size of the counts."""
    return F.expr(f"case when {total} > 0 then 1 + (cast({SCALE} as decimal(10, 0)) * (cast({n} as decimal(20, 0)) + 2)) div {total} else 1 end")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def beside(left: DataFrame, groups: DataFrame, few: bool, salt: str) -> DataFrame:
    """``left`` with every group of its lang. Beyond the bound the groups are copied to 64
    parts, to which ``left`` goes by ``salt``, so no lang is one task's."""
    if few:
        return left.join(F.broadcast(groups), "lang")
    copies = groups.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return left.withColumn("part_", F.pmod(F.xxhash64(salt), F.lit(64))).join(copies, ["lang", "part_"]).drop("part_")


def tree_pairs(length: np.ndarray, source: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair corrections of sorted rows of one lang. ``length``, ``times``: cells and
    multiplicity by row; ``source``, ``n``, ``p``, ``p0``: cells, row after row."""
    width, rows = int(length.max()), len(length)
    cells = np.arange(width) < length[:, None]

    def grid(x: np.ndarray, fill: int) -> np.ndarray:
        out = np.full((rows, width), fill, np.int64)
        out[cells] = x
        return out

    source, n, p, p0 = grid(source, -1), grid(n, -1), grid(p, 1), grid(p0, 1)
    shared = np.zeros(rows, np.int64)  # cells shared with the row before
    shared[1:] = np.cumprod((source[1:] == source[:-1]) & (n[1:] == n[:-1]) & cells[1:], 1).sum(1)
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    keys, values, base = [], [], int(source.max()) + 1
    for d in range(1, width):
        nodes = np.flatnonzero((length > d) & (shared <= d))
        if not len(nodes):
            continue
        held = np.add.reduceat(np.where(length > d, times, 0), nodes)
        b, pb, zb = source[nodes, d], p[nodes, d], p0[nodes, d]
        for e in range(d):
            a, pa_, za = source[nodes, e], p[nodes, e], p0[nodes, e]
            keys.append(a * base + b)
            values.append(held * (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)))
    if not keys:
        return (np.empty(0, np.int64),) * 3
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(values))
    return key // base, key % base, total


def both_counts(rows: DataFrame) -> DataFrame:
    """lang, a, b, value: what the nonzero counts of two sources together change, in
    parts to be added. ``rows``: (lang, path, times), sorted by lang and path."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs = batch["lang"].to_pylist()
            length = np.diff(batch["path"].offsets.to_numpy())
            cell = batch["path"].flatten()
            cols = [cell.field(c).to_numpy() for c in ("o", "n", "p", "p0")]
            ends = np.concatenate([[0], np.cumsum(length)])
            times = batch["times"].to_numpy()
            at = 0
            while at < len(langs):
                end, wide = at, 0
                while end < len(langs) and langs[end] == langs[at]:
                    wide = max(wide, int(length[end]))
                    if (end + 1 - at) * wide * wide > CELLS and end > at:
                        break
                    end += 1
                a, b, v = tree_pairs(length[at:end], *(c[ends[at] : ends[end]] for c in cols), times[at:end])
                yield pa.RecordBatch.from_arrays([pa.array([langs[at]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v)], names=["lang", "a", "b", "value"])
                at = end

    return rows.mapInArrow(run, "lang string, a long, b long, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    docs = docs.select(*map(blank, ("lang", "source")), text_bytes().alias("text"))
    counted = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("cells")).filter(F.col("df") >= least_docs)
    kept = materialize(kept.select("lang", "term", "all", "cells"), "kept")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_n"))
    by_group = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    none = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["group_n", "terms", "lang_n"])
    groups = groups.withColumn("o", F.row_number().over(W.partitionBy("lang").orderBy("group_n", "source")).cast("long"))
    groups = groups.withColumn("group_total", F.expr("group_n + 2 * terms")).withColumn("lang_total", F.expr("lang_n + 2 * terms")).withColumn("p0", scaled("0", "group_total"))
    groups = materialize(groups, "groups")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    own = groups.select("lang", "source", "o", "p0", "group_total", "lang_total")
    cells = kept.select("lang", "term", "all", F.inline("cells")).join(F.broadcast(own) if few else own, ["lang", "source"])
    cells = materialize(cells.withColumns({"p": scaled("n", "group_total"), "q": scaled("all", "lang_total")}).drop("group_total", "lang_total", "all"), "cells")

    path = F.sort_array(F.collect_list(F.struct("o", "n", "p", "p0")))
    paths = cells.groupBy("lang", "term").agg(path.alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    paths = materialize(paths, "paths")
    parts = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    joint = both_counts(paths.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("o").alias("b"), F.col("p0").alias("pb"))
    alone = cells.groupBy("lang", "o", "n", "p", "p0").agg(F.count("*").alias("times"))
    alone = beside(alone, other, few, "n").filter("o <> b").select("lang", F.col("o").alias("a"), "b", (F.col("times") * (distance(F.col("p"), F.col("pb")) - distance(F.col("p0"), F.col("pb")))).alias("value"))
    flat = beside(groups, other, few, "source").filter("o <> b").select("lang", F.col("o").alias("a"), "b", "source", "item", (F.col("terms") * distance(F.col("p0"), F.col("pb"))).alias("flat"))
    one_way = joint.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    changes = one_way.unionByName(one_way.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = flat.join(changes, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("flat") + F.coalesce("value", none)).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    more = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), t as (
  select r, lang, source, unnest(terms) as term from d
), k as (
  select lang, term, count(*) as n from t group by all having count(distinct r) >= 10
), c as (
  select t.lang, t.source, t.term, count(*) as n from t join k on t.lang = k.lang and t.term = k.term group by all
), v as (
  select lang, count(*) as v, sum(n) as n from k group by lang
), g as (
  select d.lang, d.source, coalesce(any_value(v.v), 0) as v, coalesce(any_value(v.n), 0) as lang_n, coalesce((select sum(c.n) from c where c.lang = d.lang and c.source = d.source), 0) as n
  from d left join v on v.lang = d.lang group by d.lang, d.source
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) as p, 1 + (1000000000::hugeint * (k.n + 2)) // (g.lang_n + 2 * g.v) as q
  from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), s as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
), more as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from more)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
