"""Queries for audits, narrative operators and the remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import audit, chunking, narrative, ratios, search
from tallyfold.operators import facts as fo
from tallyfold.operators import text as op
from tallyfold.plans.base import Plans
from tallyfold.plans.facts import P as SERIES
from tallyfold.plans.metrics import WIDE
from tallyfold.plans.text import COS, QUALITY, vectors
from tallyfold.plans.text import P as TEXTS
from tallyfold.sources import tables
from tallyfold.sources.bindings import CHUNKS, FACTS, FILINGS, INSIDERS, chunks, facts, filings, insiders, log, table

P = Plans()
OVER = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: len(x) > 2))"
RULES = [("cost|gross", "revenue"), ("expense", "net_income")]


def half(s, d):
    """Facts of odd suppliers lack units."""
    return facts(s, d).filter("not (metric = 'units' and confidence > 0.8)")


P.add(
    "d24_statement_completeness", lambda s, d: audit.statement_completeness(half(s, d), facts(s, d), s.createDataFrame([("income_statement", "ebitda"), ("cash_flow", "fcf")], "statement_type string, metric string")),
    """with t as (select ticker, bool_or(confidence > 0.8) as h from facts group by 1) select ticker, 'income_statement' as statement_type, 8 as wanted, case when h then 6 else 7 end as found, round(case when h then 6 else 7 end / 8.0::double, 6) as completeness from t
    union all select ticker, 'cash_flow', 1, 0, 0.0 from t""", FACTS,
)
P.add("d23_missing_metrics", lambda s, d: audit.missing_metrics(half(s, d), facts(s, d)), "select 'units' as metric, count(distinct ticker) as tickers from facts where confidence > 0.8", FACTS)
P.add(
    "d23_gap_report", lambda s, d: audit.gap_report(facts(s, d).groupBy("ticker").agg(F.max("confidence").alias("completeness")), table(s, d, "supplier").select(F.col("s_name").alias("ticker"), F.col("s_nationkey").alias("industry"))),
    "with c as (select ticker, max(confidence) as c from facts group by 1), g as (select s_nationkey as industry, count(*) as n, round(avg(c), 6) as mean, min(c) as least, max(c) as most from c join supplier on s_name = ticker group by 1) select *, case when mean < 0.5 then 'extend mappings' when mean < 0.9 then 'review gaps' else 'none' end as advice from g", FACTS,
)
def _cash_flow(s, d):
    """Net income as the cash flow statement has it: two millions off for some."""
    income = facts(s, d).filter("metric = 'net_income'")
    return income.withColumn("value", F.col("value") + F.when(F.col("confidence") > 0.8, 2e6).otherwise(10.0)).withColumn("statement_type", F.lit("cash_flow"))


P.add(
    "m11_validate_ingest", lambda s, d: audit.validate_ingest(facts(s, d).filter("fiscal_period = 'FY2000'"), facts(s, d).filter("filing_type = '10-Q'"), s.createDataFrame([("us-gaap:revenue", "revenue"), ("us-gaap:units", "units")], "tag string, canonical string"), {"cost_of_revenue": "negative"}, _cash_flow(s, d)).groupBy("canonical").agg(F.count("*").alias("n"), F.count_if(F.col("flags").contains("sign")).alias("signs"), F.count_if(F.col("flags").contains("unmapped")).alias("unmapped"), F.count_if(F.col("flags").contains("reconcile")).alias("apart")),
    "select metric as canonical, count(*) as n, count(*) filter (where metric = 'cost_of_revenue' and value > 0) as signs, count(*) filter (where metric not in ('revenue', 'units')) as unmapped, count(*) filter (where metric = 'net_income' and confidence > 0.8) as apart from facts where fiscal_period = 'FY2000' group by 1", FACTS,
)


def _failed(s, d):
    f = facts(s, d)
    return ratios.run_checks(f.unionByName(f.filter("metric = 'units'").withColumn("metric", F.lit("gross_profit"))))


P.add(
    "m13_record_failures", lambda s, d: (lambda c: audit.record_failures(c, c.filter("filing_type = '10-K'")))(_failed(s, d)),
    """select ticker, fiscal_period, filing_type, 'gross_profit' as check_name from wide_f where filing_type = '10-Q' and round(abs(revenue - cost_of_revenue - units) / greatest(abs(units), 1), 6) > 0.05
    union all select ticker, fiscal_period, filing_type, 'gross_profit_from_sales' from wide_f where filing_type = '10-Q' and round(abs(gross_sales - cost_of_revenue - units) / greatest(abs(units), 1), 6) > 0.05
    union all select ticker, fiscal_period, filing_type, 'sales_cover_revenue' from wide_f where filing_type = '10-Q' and revenue > gross_sales and round(abs(revenue - gross_sales) / greatest(abs(gross_sales), 1), 6) > 0.05""", FACTS, WIDE,
)
P.add(
    "m14_anomalies", lambda s, d: audit.anomalies(facts(s, d), chunks(s, d), ["the", "of", "der"], z=1.0, run=2, shift=1),
    f"""select ticker, metric, fiscal_period, 'outlier' as kind, severity from ({SERIES.sql["e20_zscore_outliers"]}) union all select ticker, metric, fiscal_period, 'streak', case when run > 6 then 'high' else 'medium' end from ({SERIES.sql["e22_streaks"]})
    union all select ticker, metric, fiscal_period, 'reversal', 'medium' from ({SERIES.sql["e23_reversals"]}) union all select ticker, word, null, 'tone_shift', 'low' from ({TEXTS.sql["e24_tone_shift"]})""",
)
P.add(
    "g9_persistable", lambda s, d: audit.persistable(log(s, d).select((F.col("event_id") % 20).alias("doc_id"), F.col("method").alias("metric"), F.lit("FY2024").alias("fiscal_period"), F.col("latency").alias("value"), F.col("event_id").alias("position")), s.createDataFrame([("Click", "engagement"), ("view", "engagement")], "name string, canonical string")),
    "with m as (select event_id % 20 as doc_id, case when event_type in ('click', 'view') then 'engagement' else event_type end as canonical, event_type in ('click', 'view') as resolved, value, event_id from events) select doc_id, canonical, 'FY2024' as fiscal_period, value, resolved from m qualify row_number() over (partition by doc_id, canonical order by event_id) = 1",
)
P.add(
    "c23_enrich", lambda s, d: audit.enrich(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 4, F.col("l_suppkey")).alias("context_ref")), table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("entity"))).select("l_orderkey", "l_linenumber", "entity"),
    "select l_orderkey, l_linenumber, s_name as entity from lineitem left join supplier on s_suppkey = l_suppkey and l_linenumber < 4",
)
P.add(
    "c24_link_footnotes", lambda s, d: audit.link_footnotes(table(s, d, "lineitem").select(F.col("l_orderkey").alias("filing"), F.format_string("Item (%d) and [%d]", "l_linenumber", F.col("l_linenumber") + 1).alias("label")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("filing"), F.col("l_linenumber").alias("note"), F.col("l_returnflag").alias("text"))).select("filing", "label", "note"),
    "with f as (select l_orderkey as filing, 'Item (' || l_linenumber || ') and [' || (l_linenumber + 1) || ']' as label, unnest([l_linenumber, l_linenumber + 1]) as note from lineitem) select filing, label, note from f join lineitem on l_orderkey = filing and l_linenumber = note",
)
P.add(
    "c33_validate_entities", lambda s, d: audit.validate_entities(table(s, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.initcap("n_name").alias("entity"), F.lit(0.9).alias("confidence")), table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat(F.lit("T"), "n_nationkey")).alias("ticker"), F.concat("n_name", F.lit(" Corp")).alias("company"))),
    """with c as (select n_nationkey as k, case when n_nationkey % 2 = 0 then upper(n_name) else 'T' || n_nationkey end as ticker, lower(n_name || ' Corp') as company from nation), b as (select q.n_nationkey as query_id, ticker, 0.9::double as confidence from nation q join c on upper(q.n_name) = ticker
    union all select q.n_nationkey, ticker, 0.72::double from nation q join c on contains(company, lower(q.n_name)) where len(list_intersect(string_split_regex(company, '[^a-z0-9]+'), string_split_regex(lower(q.n_name), '[^a-z0-9]+'))) > 0) select query_id, ticker, max(confidence) as confidence from b group by 1, 2""",
)
P.add(
    "e30_hedging_trend", lambda s, d: audit.hedging_trend(chunks(s, d).select("ticker", "filing_date", F.when(F.col("content").contains("tion"), "weak").otherwise("none").alias("strength"))),
    "with g as (select ticker, filing_date, count(*) filter (where contains(content, 'tion')) as weak from chunks group by 1, 2), t as (select ticker, min_by(weak, filing_date) as first, max_by(weak, filing_date) as last from g group by 1) select *, case when last > first + 2 then 'more' when last < first - 2 then 'less' else 'steady' end as trend from t", CHUNKS,
)
P.add("f7_order_by_map", lambda s, d: audit.order_by_map(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "F"], "o_orderkey"), "select o_orderkey, o_orderstatus, case o_orderstatus when 'P' then 1 when 'F' then 2 else 3 end::bigint as priority from orders")
P.add("h16_apply_sign", lambda s, d: table(s, d, "customer").select("c_custkey", ratios.apply_sign(F.col("c_acctbal"), F.when(F.col("c_custkey") % 3 == 0, "negative").when(F.col("c_custkey") % 3 == 1, "positive").otherwise("absolute")).alias("v")), "select c_custkey, case when c_custkey % 3 = 0 then -abs(c_acctbal) else abs(c_acctbal) end as v from customer")
P.add("h32_call_cost", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("i"), F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("o")).select("conv_id", audit.call_cost(F.col("i"), F.col("o"), 3.0, 15.0).alias("cost")), "select conv_id, round((sum(case when role = 'user' then length(text) else 0 end) * 3.0::double + sum(case when role = 'assistant' then length(text) else 0 end) * 15.0::double) / 1e6::double, 8) as cost from conversations group by 1")
P.add("b10_has_any_tag", lambda s, d: audit.has_any_tag(table(s, d, "part").select("p_partkey", F.split("p_type", " ").alias("tags")), "tags", ["STEEL", "BRASS", "tin"]).select("p_partkey"), "select p_partkey from part where list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS', 'tin'])")
P.add("e8_dedupe_facts", lambda s, d: fo.dedupe_facts(table(s, d, "lineitem").select(F.col("l_partkey").alias("tag"), F.col("l_returnflag").alias("period"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("l_linenumber") % 3).alias("dims"), F.concat(F.lit("c"), "l_orderkey", F.lit("_"), "l_linenumber").alias("context"))).select("tag", "period", "context"),
      "with x as (select l_partkey as tag, l_returnflag as period, l_linenumber % 3 as n, 'c' || l_orderkey || '_' || l_linenumber as context from lineitem) select tag, period, context from x qualify row_number() over (partition by tag, period order by n, length(context), context) = 1")
P.add("c7_doc_chunks", lambda s, d: table(s, d, "documents").filter("lang = 'en'").select("doc_id", "source").join(chunks(s, d).select("doc_id", "chunk_index"), "doc_id"), "select doc_id, source, chunk_index from documents join chunks using (doc_id) where lang = 'en'", CHUNKS)
P.add("d30_hit_summary", lambda s, d: __import__("tallyfold.operators.logs", fromlist=["x"]).hit_summary(chunks(s, d).withColumn("score", F.round(1 / (1 + F.col("chunk_index")), 6))), "select section_type, ticker, count(*) as n, round(sum(round(1.0::double / (1 + chunk_index), 6)) / count(*), 6) as mean_score from chunks group by 1, 2", CHUNKS)
P.add(
    "i12_mda_confidence", lambda s, d: chunks(s, d).groupBy("ticker").agg(F.count_if(F.col("content").contains("tion")).alias("t"), F.count_if(F.col("content").contains("the")).alias("r"), F.min("content").alias("g")).select("ticker", narrative.mda_confidence(F.col("t"), F.col("r"), F.col("g")).alias("confidence")),
    "select ticker, least(40, 10 * count(*) filter (where contains(content, 'tion'))) + least(30, 5 * count(*) filter (where contains(content, 'the'))) + case when length(min(content)) > 20 then 30 else 0 end as confidence from chunks group by 1", CHUNKS,
)
P.add("i13_severity", lambda s, d: chunks(s, d).select("doc_id", "chunk_index", narrative.severity(F.col("content"), ["the of"], ["tion", "und"]).alias("severity")), "select doc_id, chunk_index, case when contains(lower(content), 'the of') then 'RED_FLAG' when contains(lower(content), 'tion') or contains(lower(content), 'und') then 'AMBER' else 'GREEN_CHALLENGE' end as severity from chunks", CHUNKS)
P.add("i14_footnotes", lambda s, d: narrative.footnotes(table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))), "select page_id as id, case when contains(lower(html), 'polic') then 'policy' when contains(lower(html), 'segment') then 'segment' when contains(lower(html), 'reconcil') then 'reconciliation' else 'other' end as kind, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>'))::int as items from pages")
P.add("i15_latest_pair", lambda s, d: narrative.latest_pair(chunks(s, d), ["ticker", "section_type"]).select("ticker", "section_type", "new_date", "old_date"), "with k as (select distinct ticker, section_type, filing_date, dense_rank() over (partition by ticker, section_type order by filing_date desc) as k from chunks) select a.ticker, a.section_type, a.filing_date as new_date, b.filing_date as old_date from k a join k b on b.ticker = a.ticker and b.section_type = a.section_type and a.k = 1 and b.k = 2", CHUNKS)
P.add(
    "i5_concept_change", lambda s, d: narrative.concept_change(narrative.latest_pair(chunking.assemble_sections(chunks(s, d), 0), ["ticker", "section_type"]), ["the"], ["of"], ["tion"]).select("ticker", "section_type", "similarity", "tone", "changed"),
    r"""with g as (select ticker, section_type, filing_date, doc_id, string_agg(trim(content), ' ' order by chunk_index) as c from chunks group by 1, 2, 3, 4), k as (select *, dense_rank() over (partition by ticker, section_type order by filing_date desc) as k from g), f as (select * from k where k <= 2 qualify row_number() over (partition by ticker, section_type, k order by doc_id) = 1),
    w as (select ticker, section_type, k, list_distinct(list_filter(string_split_regex(lower(c), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) as w, greatest(0, least(10, floor(5 + 2 * contains(lower(c), 'the')::int - 1.5 * contains(lower(c), 'of')::int - 2 * contains(lower(c), 'tion')::int + 0.5)::int)) as q from f),
    s as (select a.ticker, a.section_type, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 1 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double end, 6) as similarity, a.q - b.q as tone from w a join w b on b.ticker = a.ticker and b.section_type = a.section_type and a.k = 1 and b.k = 2) select *, similarity < 0.85 or abs(tone) >= 2 as changed from s""", CHUNKS,
)
SAID = "case doc_id % 4 when 0 then ' Revenue increased by ' || (doc_id % 90 + 1) || '% then' when 1 then ' margin FELL ' || (doc_id % 50 + 1) || '.5 percent' when 2 then ' Revenue was flat and margin rose ' || (doc_id % 9 + 1) || ' %.' else ' revenue changed by 7%' end"
P.add(
    "i8_trends", lambda s, d: narrative.trends(chunks(s, d).withColumn("content", F.concat("content", F.expr(SAID))), ["revenue", "margin"]).select("ticker", "metric", "direction", "magnitude"),
    f"""with c as (select ticker, doc_id, chunk_index, {SAID} as t from chunks), h as (select *, lower(regexp_extract(t, '(?i)(revenue|margin)\\s+(increased|fell|rose)', 1)) as metric, lower(regexp_extract(t, '(?i)(revenue|margin)\\s+(increased|fell|rose)', 2)) as verb, try_cast(regexp_extract(t, '([0-9.]+)\\s?(%|percent)', 1) as double) as magnitude from c)
    select ticker, metric, case when verb = 'fell' then 'down' else 'up' end as direction, magnitude from h where metric <> '' qualify row_number() over (partition by ticker, metric order by doc_id, chunk_index) = 1""", CHUNKS,
)
CAUSE = "case doc_id % 3 when 0 then 'It fell due to lower demand in area ' || (doc_id % 17) || '. ' when 1 then 'Mostly driven by cost. As a result of new prices in ' || (doc_id % 5) || '; ' else '' end"
P.add(
    "i9_drivers", lambda s, d: chunks(s, d).select("doc_id", "chunk_index", F.array_join(narrative.drivers(F.concat(F.expr(CAUSE), F.col("content"))), "|").alias("drivers")),
    f"select doc_id, chunk_index, array_to_string(list_transform(regexp_extract_all({CAUSE} || content, '(?i)(?:due to|driven by|as a result of|attributable to)\\s+([^.;]{{10,200}})[.;]', 1), lambda x: trim(x)), '|') as drivers from chunks", CHUNKS,
)
HOPE = "case doc_id % 4 when 0 then 'We expect strong growth. ' when 1 then 'Outlook is weak and weak demand. ' when 2 then 'The guidance is strong, not weak. ' else 'Nothing here. ' end"
P.add(
    "i11_guidance", lambda s, d: narrative.guidance(chunks(s, d).withColumn("content", F.concat(F.expr(HOPE), F.col("content"))), ["strong", "growth"], ["weak"]).select("doc_id", "chunk_index", "guidance", "tone"),
    f"""with g as (select doc_id, chunk_index, trim(regexp_extract({HOPE} || content, '(?i)([^.]*\\b(?:expect|anticipate|outlook|guidance|forecast)\\w*\\b[^.]*\\.)', 1)) as guidance from chunks), t as (select *, string_split_regex(lower(guidance), '[^a-z]+') as w from g where guidance <> ''), n as (select *, len(list_filter(w, lambda x: x in ('strong', 'growth'))) as p, len(list_filter(w, lambda x: x = 'weak')) as n from t)
    select doc_id, chunk_index, guidance, case when p > 1.5 * n then 'positive' when n > 1.5 * p then 'negative' else 'neutral' end as tone from n""", CHUNKS,
)
def _versions(s, d):
    """Each document, and a newer version with a first line more and some words changed."""
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.col("text").alias("content")), docs.select("doc_id", F.concat(F.lit("brand new opening line here\n"), F.replace("text", F.lit(" the "), F.lit(" that "))).alias("content"))


P.add(
    "c20_diff_paragraphs", lambda s, d: narrative.diff_paragraphs(*_versions(s, d), "doc_id", r"\n"),
    r"""with recursive v as (select doc_id, string_split(text, chr(10)) as a, string_split('brand new opening line here' || chr(10) || replace(text, ' the ', ' that '), chr(10)) as b from documents),
    x as (select doc_id, i::int as old, WORDS(a[i + 1]) as w from v, unnest(range(len(a))) as u(i) where trim(a[i + 1]) <> ''), y as (select doc_id, i::int as new, WORDS(b[i + 1]) as w from v, unnest(range(len(b))) as u(i) where trim(b[i + 1]) <> ''),
    p as (select * from (select doc_id, old, new, case when len(x.w) + len(y.w) = 0 then 1.0 else round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::double, 6) end as s from x join y using (doc_id)) where s > 0.7),
    o as (select doc_id, old, row_number() over (partition by doc_id order by old) as k from (select distinct doc_id, old from p)),
    g as (select doc_id, 0::bigint as k, []::int[] as used, null::int as old, null::int as new from (select distinct doc_id from p)
    union all select g.doc_id, g.k + 1, case when count(p.new) = 0 then g.used else list_append(g.used, first(p.new order by p.s desc, p.new)) end, o.old, first(p.new order by p.s desc, p.new)
    from g join o on o.doc_id = g.doc_id and o.k = g.k + 1 left join p on p.doc_id = g.doc_id and p.old = o.old and not list_contains(g.used, p.new) group by g.doc_id, g.k, g.used, o.old),
    m as (select g.doc_id, g.old, g.new, p.s from g join p on p.doc_id = g.doc_id and p.old = g.old and p.new = g.new)
    select doc_id, x.old, m.new, case when m.new is null then 'removed' when s < 0.95 then 'modified' else 'unchanged' end as change, s as similarity from x left join m using (doc_id, old)
    union all select doc_id, null, y.new, 'added', null from y where (doc_id, new) not in (select (doc_id, new) from m)""".replace("WORDS(a[i + 1])", OVER.format("a[i + 1]")).replace("WORDS(b[i + 1])", OVER.format("b[i + 1]")),
)
P.add(
    "k3_filtered_vectors", lambda s, d: (lambda v: search.vector_search(v.filter("id % 100 = 0").withColumn("section", F.when(F.col("id") / 100 % 3 < 2, F.col("section")).otherwise("none")).withColumn("subsection", F.when(F.col("id") / 100 % 3 < 1, F.col("subsection")).otherwise("none")), v, 3).select("query_id", "id", "stage"))(vectors(s, d).select("id", "v", F.col("metric").cast("string").alias("section"), (F.col("id") % 2).cast("string").alias("subsection"))),
    """with p as (select *, (query_id // 100) % 3 as kind, (select any_value(label) from embeddings e where e.vec_id = query_id) as own from cosx), c as (select query_id, id, score, case when kind = 0 and metric = own and id % 2 = query_id % 2 then 1 when kind < 2 and metric = own then 2 else 3 end as stage from p),
    f as (select query_id, min(stage) as stage from c group by 1) select query_id, id, f.stage from c join f using (query_id) where c.stage <= f.stage qualify row_number() over (partition by query_id order by score desc, id) <= 3""", COS,
)
P.add("k8_embed_missing", lambda s, d: narrative.embed_missing(chunks(s, d).select("doc_id", "chunk_index", "content", F.when(F.col("chunk_index") % 2 == 1, F.array(F.lit(-1.0).cast("float"))).alias("v")), _lengths).select("doc_id", "chunk_index", F.col("v")[0].cast("int").alias("n")), "select doc_id, chunk_index, case when chunk_index % 2 = 1 then -1 else length(content)::int end as n from chunks", CHUNKS)
P.add("a9_upsert_insiders", lambda s, d: (lambda i: __import__("tallyfold.sources.tables", fromlist=["x"]).upsert(i.filter("code <> '1'"), i.filter("code in ('1', '2')").withColumn("amount", F.lit(0.0)), ["ticker", "accession"]))(insiders(s, d)), "select ticker, accession, transaction_date, code, case when code in ('1', '2') then 0 else amount end as amount from insiders", INSIDERS)
P.add("a10_filing_counts", lambda s, d: filings(s, d).join(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.count("*").alias("metrics_count")), "accession", "left").select("accession", F.coalesce("metrics_count", F.lit(0)).alias("metrics_count"), F.col("metrics_count").isNotNull().alias("processed")), "with n as (select l_orderkey as accession, count(*) as c from lineitem group by 1) select accession, coalesce(c, 0) as metrics_count, c is not null as processed from filings left join n using (accession)", FILINGS)
P.add("b14_insider_codes", lambda s, d: insiders(s, d).groupBy("code").agg(F.count("*").alias("n")), "select code, count(*) as n from insiders group by 1", INSIDERS)
P.add("h25_quality_bands", lambda s, d: table(s, d, "documents").select("doc_id", op.band_label(op.text_quality(F.col("text")), [(0.8, None, "good"), (None, 0.8, "poor")]).alias("band")), "select doc_id, case when issues <= 1 then 'good' else 'poor' end as band from quality", QUALITY)
P.add("h30_industry_parent", lambda s, d: fo.industry_of(facts(s, d).filter("filing_type = '10-K'"), table(s, d, "supplier").filter("s_nationkey < 20").select(F.upper("s_name").alias("ticker"), F.concat(F.lit("i"), "s_nationkey").alias("industry"))).withColumn("parent", fo.parent_metric(F.col("metric"), RULES)).select("ticker", "metric", "fiscal_period", "industry", "parent", fo.indent_of(F.col("metric"), F.col("parent")).alias("indent")),
      "with p as (select ticker, metric, fiscal_period, coalesce('i' || s_nationkey, 'other') as industry, case when metric in ('cost_of_revenue', 'gross_sales') then 'revenue' when metric in ('operating_expenses', 'income_tax_expense') then 'net_income' end as parent from facts left join supplier on s_name = ticker and s_nationkey < 20 where filing_type = '10-K') select *, case when parent is null then 0 else 1 end as indent from p", FACTS)
P.add("a8_upsert_chunks", lambda s, d: (lambda c: tables.upsert(c, c.filter("chunk_index = 0").withColumn("content", F.lit("new")), ["doc_id", "filing_type", "section_type", "chunk_index"]).select("doc_id", "chunk_index", F.length("content").alias("n")))(chunks(s, d)), "select doc_id, chunk_index, case when chunk_index = 0 then 3 else length(content) end::int as n from chunks", CHUNKS)
P.add("a12_replace_documents", lambda s, d: (lambda c: tables.replace_documents(c, c.filter("doc_id % 3 = 0 and chunk_index = 0"), c.filter("doc_id % 3 = 0 or doc_id % 5 = 0").select("doc_id")))(chunks(s, d).select("doc_id", "chunk_index")), "select doc_id, chunk_index from chunks where not (doc_id % 3 = 0 or doc_id % 5 = 0) or (doc_id % 3 = 0 and chunk_index = 0)", CHUNKS)


def _lengths(texts):
    return [[float(len(t))] for t in texts]
