"""Queries for sources, sinks as batch steps, statements, and batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import statements
from tallyfold.plans.base import Plans
from tallyfold.sources import tables as op
from tallyfold.sources.bindings import CHUNKS, FACTS, FILINGS, LOG, chunks, facts, filings, log, table
from tallyfold.sources.keyed import KeyedTable
from tallyfold.sources.scratch import scratch_path
from tallyfold.streaming import jobs, state

P = Plans()
TEMPLATE = [(1, "Income", None, True, 0), (2, "Revenue", "revenue", False, 1), (3, "Profit", "net_income", False, 1), (4, "Never", "ebitda", False, 1)]


def template(s):
    return s.createDataFrame(TEMPLATE, "position int, name string, metric string, is_header boolean, indent int")


GRID = "t(position, name, metric, is_header, indent) as (values (1, 'Income', null, true, 0), (2, 'Revenue', 'revenue', false, 1), (3, 'Profit', 'net_income', false, 1), (4, 'Never', 'ebitda', false, 1))"
P.add(
    "n1_statement", lambda s, d: statements.statement(facts(s, d), template(s), ["FY1997", "FY1998"]),
    f"""with {GRID}, k as (select distinct ticker from facts) select k.ticker, t.position, t.name, t.is_header, t.indent, a.value as "FY1997", b.value as "FY1998" from k cross join t left join facts a on a.ticker = k.ticker and a.metric = t.metric and a.fiscal_period = 'FY1997'
    left join facts b on b.ticker = k.ticker and b.metric = t.metric and b.fiscal_period = 'FY1998'""", FACTS,
)
P.add(
    "n2_statement_industry", lambda s, d: statements.statement_industry(facts(s, d), template(s), s.createDataFrame([(2, "net_sales", 1), (2, "revenue", 2), (2, "gross_sales", 3), (3, "net_income", 1)], "position int, metric string, priority int"), ["FY1997"]),
    f"""with {GRID}, k as (select distinct ticker from facts) select k.ticker, t.position, t.name, a.value as "FY1997" from k cross join t left join facts a on a.ticker = k.ticker and a.metric = t.metric and a.fiscal_period = 'FY1997'""", FACTS,
)
P.add(
    "a17_melt_statement", lambda s, d: statements.melt_statement(table(s, d, "part").select(F.concat(F.when(F.col("p_size") > 25, "  Total ").otherwise("Item "), "p_partkey").alias("label"), F.format_number("p_retailprice", 2).alias("2024"), F.when(F.col("p_size") > 10, F.lit("1,000")).otherwise("n/a").alias("2025E")), "label", ["2024", "2025E"]),
    """with g as (select trim(case when p_size > 25 then '  Total ' else 'Item ' end || p_partkey) as label, p_size > 25 as is_total, p_size, p_retailprice from part)
    select label, '2024' as fiscal_period, round(p_retailprice, 2) as value, false as projected, is_total, is_total::int as indent from g union all select label, '2025E', 1000.0::double, true, is_total, is_total::int from g where p_size > 10""",
)
P.add("a18_first_numeric", lambda s, d: statements.first_numeric(table(s, d, "part").select(F.col("p_name").alias("label"), F.lit("n/a").alias("a"), F.when(F.col("p_size") > 10, F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("b")), "label", ["a", "b"]), "select trim(p_name) as label, p_size::double as value from part where p_size > 10")


def submissions(s, d):
    """Per ticker the parallel arrays of its filings, the documents' array one short."""
    f = filings(s, d).withColumn("x", F.struct("accession", "form", "filing_date"))
    g = f.groupBy("ticker").agg(F.sort_array(F.collect_list("x")).alias("x"))
    acc = F.transform("x", lambda r: F.format_string("%010d-20-1", r["accession"]))
    return g.select(F.lpad(F.col("ticker").cast("string"), 10, "0").alias("cik"), F.transform("x", lambda r: r["form"]).alias("form"), F.transform("x", lambda r: r["filing_date"].cast("string")).alias("filingDate"), acc.alias("accessionNumber"), F.slice(F.transform("x", lambda r: F.lit("d.htm")), F.lit(1), F.size("x") - 1).alias("primaryDocument"))


P.add(
    "a1_filings_from_submissions", lambda s, d: op.filings_from_submissions(submissions(s, d)),
    """with f as (select *, row_number() over (partition by ticker order by accession) as k, count(*) over (partition by ticker) as n from filings)
    select lpad(ticker::varchar, 10, '0') as cik, form, filing_date::varchar as "filingDate", lpad(accession::varchar, 10, '0') || '-20-1' as "accessionNumber", case when k < n then 'd.htm' end as "primaryDocument",
    case when k < n then '/Archives/edgar/data/' || ticker || '/' || lpad(accession::varchar, 10, '0') || '201/d.htm' end as path from f""", FILINGS,
)
P.add("a2_union_pages", lambda s, d: op.union_pages(filings(s, d).filter("accession % 2 = 0"), filings(s, d).filter("accession % 2 = 1").drop("status")).select("accession", "status"), "select accession, case when accession % 2 = 0 then status end as status from filings", FILINGS)


def company_facts(s, d):
    f = facts(s, d).filter("filing_type = '10-K'")
    rows = F.collect_list(F.struct(F.col("statement_date").cast("string").alias("end"), F.col("value").alias("val"), F.col("filing_type").alias("form"), F.col("filing_date").cast("string").alias("filed")))
    t = f.groupBy("ticker", "metric").agg(rows.alias("r"))
    unit = F.create_map(F.when(F.col("metric") == "units", "shares").otherwise("USD"), F.col("r"))
    tags = t.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(unit.alias("units"))))).alias("tags"))
    return tags.select(F.col("ticker").alias("cik"), F.to_json(F.create_map(F.lit("us-gaap"), F.col("tags"))).alias("facts"))


P.add("a3_facts_from_companyfacts", lambda s, d: op.facts_from_companyfacts(company_facts(s, d), ["usd"]), "select ticker as cik, 'us-gaap' as taxonomy, metric as tag, 'USD' as unit, statement_date::varchar as \"end\", value as val, filing_type as form, filing_date::varchar as filed from facts where filing_type = '10-K' and metric <> 'units'", FACTS)
KEYS = ["ticker", "metric", "fiscal_period", "filing_type"]
P.add(
    "a7_upsert_facts", lambda s, d: (lambda f: op.upsert(f.filter("filing_type = '10-K'"), f.filter("fiscal_period in ('FY1998', 'Q1 1998')").withColumn("value", F.col("value") + 1), KEYS))(facts(s, d).select(*KEYS, "value")),
    "select ticker, metric, fiscal_period, filing_type, case when fiscal_period in ('FY1998', 'Q1 1998') then value + 1 else value end as value from facts where filing_type = '10-K' or fiscal_period = 'Q1 1998'", FACTS,
)
P.add("a11_insert_ignore", lambda s, d: (lambda f: op.insert_ignore(f.filter("filing_type = '10-K'"), f.withColumn("value", F.lit(0.0)), KEYS))(facts(s, d).select(*KEYS, "value")), "select ticker, metric, fiscal_period, filing_type, case when filing_type = '10-K' then value else 0 end as value from facts", FACTS)
P.add("a13_drop_entity", lambda s, d: op.drop_entity([chunks(s, d)], "src1")[0].groupBy("ticker").agg(F.count("*").alias("n")), "select ticker, count(*) as n from chunks where ticker <> 'src1' group by 1", CHUNKS)
P.add("a16_export_chunks", lambda s, d: op.export_chunks(chunks(s, d), ["10-K"]).groupBy("visibility", "page").agg(F.count("*").alias("n")), "with n as (select filing_type, (row_number() over (partition by ticker order by doc_id, chunk_index) - 1) // 5000 as page from chunks) select case when filing_type = '10-K' then 'public' else 'private' end as visibility, page::int as page, count(*) as n from n group by 1, 2", CHUNKS)
P.add("a22_backfill", lambda s, d: op.backfill(log(s, d).select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.col("method")).alias("method")), log(s, d).filter("event_id % 5 = 0").groupBy("user_id").agg(F.max("method").alias("method")), ["user_id"], "method", "none").select("event_id", "method"), "with d as (select user_id, max(method) as m from log where event_id % 5 = 0 group by 1) select event_id, coalesce(case when event_id % 2 = 0 then method end, m, 'none') as method from log left join d using (user_id)", LOG)
P.add(
    "a25_metrics_from_extractions", lambda s, d: op.metrics_from_extractions(log(s, d).select(F.col("event_id").alias("id"), F.to_json(F.struct(F.when(F.col("method") == "click", "metric").otherwise(F.col("method")).alias("type"), F.col("method").alias("metric_key"), F.col("latency").alias("value"), F.when(F.col("event_id") % 2 == 0, 0.5).alias("confidence"))).alias("data"))),
    "select event_id as id, 'click' as metric, latency as value, '' as context, false as is_estimate, case when event_id % 2 = 0 then 0.5 else 0.8 end::double as confidence from log where method = 'click' and latency is not null", LOG,
)
P.add(
    "o3_log_rates_windows", lambda s, d: jobs.stream_log_rates(log(s, d)).select("tenant", F.col("w.start").alias("from_ts"), "n", "failures", F.col("latency").cast("double").alias("latency")),
    "with w as (select *, unnest(range(0, 7)) as k from log) select tenant, date_trunc('day', ts) - to_days(k::int) as from_ts, count(*) as n, count(*) filter (where not success) as failures, sum(coalesce(latency, 0)::decimal(20,4))::double as latency from w group by 1, 2", LOG,
)
P.add("o4_counters", lambda s, d: jobs.stream_counters(log(s, d)).select("method", F.col("w.start").alias("from_ts"), "n", "failures"), "select method, time_bucket(interval '5 minutes', ts) as from_ts, count(*) as n, count(*) filter (where not success) as failures from log group by 1, 2", LOG)
P.add(
    "o5_sessions", lambda s, d: jobs.stream_sessions(log(s, d), "12 hours").select("user_id", F.col("w.start").alias("from_ts"), "n", F.col("total").cast("double").alias("total")),
    """with g as (select *, coalesce(ts >= lag(ts) over w + interval '12 hours', true)::int as new from log window w as (partition by user_id order by ts)), x as (select *, sum(new) over (partition by user_id order by ts) as k from g)
    select user_id, min(ts) as from_ts, count(*) as n, sum(coalesce(latency, 0)::decimal(20,4))::double as total from x group by user_id, k""", LOG,
)
P.add("o6_rates", lambda s, d: jobs.stream_rates(log(s, d), 2, "1 hour").select(F.col("w.start").alias("from_ts"), "n"), "select date_trunc('hour', ts) as from_ts, count(*) as n from log group by 1 having count(*) > 2", LOG)
P.add("o2_expire", lambda s, d: jobs.expire(log(s, d), "2024-02-10").select("event_id"), "select event_id from log where ts > timestamp '2024-01-11'", LOG)
P.add(
    "o1_detections", lambda s, d: state.detections(log(s, d).select(F.col("user_id").alias("ticker"), F.when(F.col("success"), F.col("event_id") % 500).alias("accession"), "ts", (~F.col("success")).alias("failed"))),
    """with c as (select user_id as ticker, case when success then event_id % 500 end as accession, ts, not success as failed from log), f as (select ticker, accession, min(ts) as ts from c where accession is not null group by 1, 2),
    g as (select ticker, max(ts) as last_filing, count(*) as filings from f group by 1), r as (select ticker, ts, min((failed)::int) over (partition by ticker order by ts desc, accession desc nulls last rows unbounded preceding) as failing from c),
    h as (select ticker, max(ts) as last_check, sum(failing)::bigint as failures from r group by 1) select h.ticker, last_check, last_filing, coalesce(filings, 0) as filings, failures from h left join g using (ticker)""", LOG,
)


def keyed(s, rows, by) -> KeyedTable:
    out = KeyedTable.create(s, scratch_path(s, "keyed"), rows.schema, by, 32)
    out.upsert(rows, rows.columns)
    return out


def _facts_upserted(s, d):
    f = facts(s, d).select(*KEYS, "value")
    target = keyed(s, f.filter("filing_type = '10-K'"), ["ticker"])
    target.upsert(f.filter("fiscal_period in ('FY1998', 'Q1 1998')").withColumn("value", F.col("value") + 1), KEYS)
    return target.read()


def _documents_replaced(s, d):
    c = chunks(s, d).select("doc_id", "chunk_index")
    target = keyed(s, c, ["doc_id"])
    target.replace_documents(c.filter("doc_id % 3 = 0 and chunk_index = 0"), c.filter("doc_id % 3 = 0 or doc_id % 5 = 0").select("doc_id"))
    return target.read()


P.add("a7_keyed_upsert", _facts_upserted, P.sql["a7_upsert_facts"])
P.add("a12_keyed_replace", _documents_replaced, "select doc_id, chunk_index from chunks where not (doc_id % 3 = 0 or doc_id % 5 = 0) or (doc_id % 3 = 0 and chunk_index = 0)", CHUNKS)
