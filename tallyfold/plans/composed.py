"""Queries for composed retrieval and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import pipelines as op
from tallyfold.operators.text_index import TextIndex
from tallyfold.plans import text
from tallyfold.plans.base import Plans
from tallyfold.plans.metrics import WIDE
from tallyfold.plans.text import asked as cascade
from tallyfold.sources.bindings import CHUNKS, FACTS, TREE, chunks, facts, table, tree
from tallyfold.sources.scratch import scratch_path

P = Plans()


def asked(s):
    return s.createDataFrame([(1, "src1", "the of", ["the", "tion"]), (2, "src2", "something", ["und", "der"]), (3, "src3", "none", ["zzzzz"])], "query_id int, ticker string, phrase string, terms array<string>")


K2 = r"""with q as (select * from (values (1, 'src1', 'the of', ['the', 'tion']), (2, 'src2', 'something', ['und', 'der']), (3, 'src3', 'none', ['zzzzz'])) v(query_id, ticker, phrase, terms)),
w as (select doc_id, chunk_index, ticker, length(content) as n, lower(content) as c, list_distinct(string_split_regex(lower(content), '[^\p{L}\p{N}]+')) as w from chunks),
m as (select query_id, q.ticker, doc_id, chunk_index, n, len(list_intersect(w, terms)) as matched, len(terms) as wanted, length(phrase) > 10 and contains(c, phrase) as said from w, q where list_has_any(w, terms) AND_SCOPE),
t as (select *, case when said then 1 when matched = wanted then 2 else 3 end as stage from m), f as (select * from t qualify stage = min(stage) over (partition by query_id)),
g as (select query_id, ticker, doc_id, chunk_index, stage, round(least(0.95, 0.3 + case when stage = 1 then 0.4 else 0 end + 0.2 * matched / wanted::double + case when n > 1000 then 0.05 else 0 end)::double, 6) as score from f),
b as (select * from g qualify row_number() over (partition by query_id order by score desc, doc_id, chunk_index) <= TOP)
"""
K5 = K2.replace("AND_SCOPE", "").replace("TOP", "5") + """, r as (select query_id, doc_id, chunk_index, (sum(ceil(length(content) / 4.0)) over (partition by query_id order by score desc, doc_id, chunk_index rows unbounded preceding))::bigint as running from b join chunks using (doc_id, chunk_index))
select * from r where running <= 900"""
K2 = K2.replace("AND_SCOPE", "and w.ticker = q.ticker").replace("TOP", "3") + "select * from b"


def word_index(s, d) -> TextIndex:
    return TextIndex.build(chunks(s, d), scratch_path(s, "text-index"))


P.add("k2_search_multi", lambda s, d: op.search_multi(asked(s), chunks(s, d), 3), K2, CHUNKS)
P.add("k1_indexed", lambda s, d: word_index(s, d).search(cascade(s), 5), text.P.sql["k1_search_chunks"])
P.add("k2_indexed", lambda s, d: op.search_multi(asked(s), word_index(s, d), 3), K2, CHUNKS)
P.add(
    "k4_context_metrics", lambda s, d: op.context_metrics(s.createDataFrame([(1, "Sales"), (1, "xyz"), (2, "none")], "query_id int, term string"), s.createDataFrame([("revenue", "sales")], "canonical string, name string"), facts(s, d), ["net_income", "units"]),
    """with l as (select ticker, metric, fiscal_period, value from facts where filing_type = '10-K' qualify row_number() over (partition by ticker, metric order by filing_date desc, fiscal_period) = 1)
    select 1 as query_id, ticker, metric, fiscal_period, value from l where metric = 'revenue' union all select 2, ticker, metric, fiscal_period, value from l where metric in ('net_income', 'units')""", FACTS,
)
P.add("k5_retrieve_context", lambda s, d: op.retrieve_context(asked(s).drop("ticker"), chunks(s, d), 5, 900).select("query_id", "doc_id", "chunk_index", "running"), K5, CHUNKS)
P.add("k5_indexed", lambda s, d: op.retrieve_context(asked(s).drop("ticker"), word_index(s, d), 5, 900).select("query_id", "doc_id", "chunk_index", "running"), K5, CHUNKS)
P.add(
    "p1_register_formulas", lambda s, d: op.register_formulas(s.createDataFrame([("net_margin", "net_income / revenue", "approved"), ("bad", "drop table", "pending")], "name string, formula string, status string"), facts(s, d)).select("ticker", "fiscal_period", "filing_type", "metric", "value"),
    "select ticker, fiscal_period, filing_type, 'net_margin' as metric, round(net_income / nullif(revenue, 0), 6) as value from wide_f", FACTS, WIDE,
)
P.add(
    "p2_load_overlay", lambda s, d: op.load_overlay(table(s, d, "part").select(F.col("p_type").alias("query")).distinct(), table(s, d, "part").select(F.col("p_type").alias("name"), F.upper("p_type").alias("canonical")).distinct(), s.createDataFrame([("t1", "SMALL", "own"), ("t2", "STEEL", "own")], "tenant string, name string, canonical string"), "t1").select("query", "canonical"),
    "select distinct p_type as query, case when lower(p_type) = 'small' then 'own' else upper(p_type) end as canonical from part",
)
P.add("p3_add_mapping", lambda s, d: op.add_mapping(s.createDataFrame([("a", "x", "1.0.3")], "tag string, canonical string, version string"), s.createDataFrame([("us-gaap:units", "units")], "tag string, canonical string"), facts(s, d))[2].select("ticker", "fiscal_period", "metric"), "select ticker, fiscal_period, metric from facts where metric = 'units'", FACTS)
P.add("p4_with_embedding", lambda s, d: op.with_embedding(chunks(s, d), _size).select("doc_id", "chunk_index", F.col("v")[0].cast("int").alias("n")), "select doc_id, chunk_index, length(content)::int as n from chunks", CHUNKS)


def _chunked(s, d):
    s.udtf.register("chunk_text", op.ChunkText)
    table(s, d, "documents").select("doc_id", "text").createOrReplaceTempView("texts_to_chunk")
    return s.sql("select doc_id, chunk_index, start, md5(content) as key from texts_to_chunk, lateral chunk_text(text, 1500, 200)")


P.add("p5_chunk_udtf", _chunked, text.P.sql["j2_chunk_chars"])
P.add("n3_statement_tree", lambda s, d: op.statement_tree(tree(s, d).withColumn("name", F.concat(F.lit("row "), "id"))).select("id", "indent", "name", "value"), "select id, level as indent, 'row ' || id as name, value from tree", TREE)


def _size(texts):
    return [[float(len(t))] for t in texts]
