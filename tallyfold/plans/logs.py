"""Queries over logs, filings, holdings and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import logs as op
from tallyfold.operators import sketches
from tallyfold.operators.facts import ranked
from tallyfold.plans.base import Plans
from tallyfold.sources.bindings import FACTS, FILINGS, HOLDINGS, INSIDERS, LOG, facts, filings, holdings, insiders, log, table
from tallyfold.sources.scratch import scratch_path

P = Plans()


def asked(s, d):
    """The log with a query text: method and a bucket of users."""
    return log(s, d).withColumn("query", F.concat("method", F.lit(" "), (F.col("user_id") % 7).cast("string"))).withColumn("weight", F.lit(1)).withColumn("confidence", F.lit(0.9))


ASKED = "asked as (select *, method || ' ' || (user_id % 7) as query from log)"
P.add(
    "d5_log_summary", lambda s, d: op.log_summary(log(s, d), "2024-01-05", "2024-01-20"),
    """select tenant, count(*) as n, count(*) filter (where method = 'click') as n_click, count(*) filter (where method = 'purchase') as n_purchase, count(*) filter (where method = 'view') as n_view, count(*) filter (where not success) as failures,
    round(avg(latency), 4) as avg_latency, sum(coalesce(latency, 0)::decimal(20,4))::double as total_latency from log where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""", LOG,
)
P.add(
    "d6_log_rates", lambda s, d: op.log_rates(log(s, d), "2024-01-20"),
    """with r as (select *, ts >= timestamp '2024-01-19' as day from log where ts >= timestamp '2024-01-13' and ts < timestamp '2024-01-20')
    select tenant, count(*) filter (where day) as n_day, count(*) as n_week, round(count(*) filter (where day and not success) / nullif(count(*) filter (where day), 0)::double, 6) as failure_day, round(count(*) filter (where not success) / count(*)::double, 6) as failure_week,
    round(sum(coalesce(latency, 0)::decimal(20,4))::double / 7 * 30, 4) as monthly_cost from r group by 1""", LOG,
)
P.add("d7_top_failures", lambda s, d: op.top_failures(asked(s, d), 5), "select query, count(*) as n from asked where not success group by 1 order by n desc, query limit 5", LOG, ASKED)
P.add(
    "d8_failure_patterns", lambda s, d: op.failure_patterns(asked(s, d), F.regexp_replace("query", r"\d+", "[NUMBER]"), 3),
    """with f as (select *, regexp_replace(query, '\\d+', '[NUMBER]', 'g') as pattern from asked where not success), n as (select pattern, count(*) as n from f group by 1), x as (select distinct pattern, query from f qualify dense_rank() over (partition by pattern order by query) <= 3)
    select n.pattern, n.n, (select string_agg(query, '|' order by query) from x where x.pattern = n.pattern) as examples from n""", LOG, ASKED,
)
P.add("d9_top_requested", lambda s, d: op.top_requested(asked(s, d)), "select query, count(*) as requests, max(ts) as last, string_agg(distinct tenant::varchar, ',' order by tenant::varchar) as tenants from asked group by 1 having count(*) >= 2 order by 2 desc, 3 desc, 1 limit 20", LOG, ASKED)
P.add(
    "d11_audit_stats", lambda s, d: op.audit_stats(log(s, d), 3),
    "select 'total' as kind, 'total' as name, count(*) as n from log union all select 'total', 'ok', count(*) from log where success union all select 'total', 'users', count(distinct user_id) from log union all (select 'action', method, count(*) as n from log group by 2 order by n desc, 2 limit 3)", LOG,
)
P.add("d12_status_counts", lambda s, d: op.status_counts(log(s, d), "method", ["click", "error"]), "select count(*) filter (where method = 'click') as click, count(*) filter (where method = 'error') as error, count(*) filter (where method not in ('click', 'error')) as other, count(*) as total from log", LOG)
P.add("d14_type_counts", lambda s, d: op.status_counts(table(s, d, "documents"), "lang", ["en", "de"]), "select count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'de') as de, count(*) filter (where lang not in ('en', 'de')) as other, count(*) as total from documents")
P.add("d15_document_stats", lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), "select lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
P.add(
    "d16_citation_stats", lambda s, d: op.citation_stats(log(s, d).select((F.col("event_id") % 150).alias("doc_id"), F.col("latency").alias("score")), table(s, d, "documents").select("doc_id", F.col("lang").alias("source_type"))),
    "select lang as source_type, count(*) as n, count(distinct doc_id) as documents, round(avg(latency), 6) as mean_score from log join documents on doc_id = event_id % 150 group by 1", LOG,
)
P.add(
    "d17_chat_stats", lambda s, d: op.chat_stats(table(s, d, "conversations")),
    "with s as (select conv_id, count(*) as n, sum(ceil(length(text) / 4.0))::bigint as tokens from conversations group by 1) select sum(n)::bigint as messages, count(*) as sessions, round(avg(n), 6) as avg_messages, round(sum(n * n) / sum(n)::double, 6) as avg_messages_weighted, sum(tokens)::bigint as tokens from s",
)
P.add("d18_usage_stats", lambda s, d: op.usage_stats(log(s, d), {"purchase": 2.0, "click": 0.5}), "select method, count(*) as n, round(sum(case method when 'purchase' then 2.0 when 'click' then 0.5 else 0 end::double), 4) as cost from log group by 1", LOG)
P.add("d18_top_sessions", lambda s, d: op.top_sessions(table(s, d, "conversations")), "select conv_id, sum(ceil(length(text) / 4.0))::bigint as tokens from conversations group by 1 order by 2 desc, 1 limit 10")
P.add(
    "d19_queue_stats", lambda s, d: op.queue_stats(orders=table(s, d, "orders").select(F.col("o_orderstatus").alias("status")), lines=table(s, d, "lineitem").select(F.col("l_linestatus").alias("status")), events=log(s, d).select(F.col("method").alias("status"))),
    "select 'orders' as queue, o_orderstatus as status, count(*) as n from orders group by 2 union all select 'lines', l_linestatus, count(*) from lineitem group by 2 union all select 'events', event_type, count(*) from events group by 2",
)
PROFILE = "count(latency) as n, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.95) as p95, quantile_disc(latency, 0.99) as p99, min(latency) as min, max(latency) as max, round(avg(latency), 6) as avg, count(*) filter (where latency > 5) as over_5, count(*) filter (where latency > 10) as over_10, count(*) filter (where latency > 30) as over_30, count(*) filter (where latency > 120) as over_120"
P.add("d21_latency_profile", lambda s, d: op.latency_profile(log(s, d), ["method"]), f"with p as (select method, {PROFILE} from log group by 1) select *, n < 10 or (p95 <= 5 and over_120 = 0 and over_10 < 0.2 * n) as healthy from p", LOG)
P.add(
    "d22_resolution_metrics", lambda s, d: op.resolution_metrics(log(s, d)),
    """with r as (select method, latency, success, row_number() over (partition by method order by latency) - 1 as rn, count(*) over (partition by method) as n from log where latency is not null)
    select method, max(n) as n, max(latency) filter (where rn = least(floor(n * 0.5), n - 1)) as p50, max(latency) filter (where rn = least(floor(n * 0.99), n - 1)) as p99, round(avg(success::int), 6) as success_rate from r group by 1""", LOG,
)


def parts_of(s, d):
    """Five-minute parts of the log, kept in two batches that share their windows."""
    path = scratch_path(s, "parts")
    for k in (0, 1):
        sketches.store(sketches.windowed(log(s, d).filter(F.col("event_id") % 2 == k)), path, k)
    return sketches.stored(s, path)


COUNTED = """count(*) as rows, count(latency) as n, count(*) filter (where not success) as failures, count(*) filter (where latency > 5) as over_5, count(*) filter (where latency > 10) as over_10, count(*) filter (where latency > 30) as over_30, count(*) filter (where latency > 120) as over_120"""
P.add(
    "d21_sketch_profile", lambda s, d: sketches.checked(sketches.profile(sketches.rolled(parts_of(s, d), ["tenant", "method"])), log(s, d), ["tenant", "method"]).drop("p50", "p95", "p99"),
    f"""with p as (select tenant, method, {COUNTED}, quantile_disc(latency, 0.95) as p95, min(latency) as min, max(latency) as max, round(sum(latency::decimal(20,4))::double / count(latency), 6) as avg from log group by 1, 2)
    select * exclude (p95), n < 10 or (p95 <= 5 and over_120 = 0 and over_10 < 0.2 * n) as healthy, true as p50_near, true as p95_near, true as p99_near from p""", LOG,
)
P.add("d22_sketch_metrics", lambda s, d: sketches.metrics(sketches.rolled(parts_of(s, d), ["tenant"], "day")).drop("p50", "p99"), f"select tenant, date_trunc('day', ts) as start, {COUNTED}, round(1 - count(*) filter (where not success) / count(*)::double, 6) as success_rate from log group by 1, 2", LOG)
P.add("o4_counters_by_hour", lambda s, d: sketches.rolled(parts_of(s, d), ["method"], "hour").select("method", "start", *sketches.COUNTS, F.col("total").cast("double").alias("total"), "min", "max"), f"select method, date_trunc('hour', ts) as start, {COUNTED}, sum(latency::decimal(20,4))::double as total, min(latency) as min, max(latency) as max from log group by 1, 2", LOG)
P.add("e29_recent_profile", lambda s, d: op.latency_profile(op.recent(log(s, d), 200)), f"with p as (select {PROFILE} from (select * from log order by ts desc, event_id desc limit 200)) select *, n < 10 or (p95 <= 5 and over_120 = 0 and over_10 < 0.2 * n) as healthy from p", LOG)
P.add("a20_latest_valid", lambda s, d: op.latest_valid(log(s, d), "user_id", "2024-01-20", "2 DAYS").select("user_id", "event_id", "latency"), "select user_id, event_id, latency from (select * from log where ts <= timestamp '2024-01-20' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where ts > timestamp '2024-01-18'", LOG)
P.add(
    "a19_headlines", lambda s, d: op.headlines(log(s, d).select(F.to_json(F.struct(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), "event_id")).alias("headline"), F.concat(F.lit("http://x/"), "event_id").alias("url"), F.unix_timestamp("ts").cast("string").alias("datetime"))).alias("body")), 40),
    "select 't' || event_id as title, 'http://x/' || event_id as link, date_trunc('second', ts) as ts from log where event_id % 3 > 0 order by ts desc, title limit 40", LOG,
)
P.add("b11_unexpired", lambda s, d: op.unexpired(log(s, d).withColumn("expires_at", F.when(F.col("event_id") % 10 > 0, F.col("ts"))), "2024-01-25").select("event_id"), "select event_id from log where event_id % 10 = 0 or ts > timestamp '2024-01-25'", LOG)
P.add(
    "d37_due_tickers", lambda s, d: op.due_tickers(log(s, d).withColumn("ticker", F.col("user_id")), log(s, d).filter("method = 'purchase'").select(F.col("user_id").alias("ticker")).distinct(), 3),
    "select user_id as ticker, count(*) as n, max(ts) as last from log group by 1 having count(*) >= 3 and user_id not in (select user_id from log where method = 'purchase')", LOG,
)


def states(s, d):
    f = filings(s, d)
    return f.groupBy("ticker").agg(F.max("filing_date").cast("timestamp").alias("last_check"), F.count_if(F.col("status") == "P").alias("failures"))


STATES = "states as (select ticker, max(filing_date)::timestamp as last_check, count(*) filter (where status = 'P') as failures from filings group by 1)"
P.add("d33_detection_summary", lambda s, d: op.detection_summary(states(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("ticker"))), "select count(*) as tracked, count(last_check) as checked, count(*) - count(last_check) as never, count(*) filter (where failures > 0) as failing, max(last_check) as last_check from customer left join states on ticker = c_custkey", FILINGS, STATES)
P.add("o7_stale", lambda s, d: op.stale(states(s, d), "2030-01-01"), "select max(last_check) as last_check, true as stale from states", FILINGS, STATES)
P.add(
    "d35_count_gaps", lambda s, d: op.count_gaps(table(s, d, "orders").select(F.col("o_orderkey").alias("filing"), (F.col("o_orderkey") % 6).alias("declared")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("filing"))),
    "with n as (select l_orderkey as filing, count(*) as c from lineitem group by 1) select o_orderkey as filing, o_orderkey % 6 as declared, coalesce(c, 0) as actual, o_orderkey % 6 - coalesce(c, 0) as missing, coalesce(c, 0) < 3 as thin from orders left join n on filing = o_orderkey",
)
P.add("d36_unsynced", lambda s, d: op.unsynced(table(s, d, "documents").select(F.col("source").alias("ticker"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).alias("external_id"))), "with g as (select source as ticker, count(*) as total, count(*) filter (where doc_id % 4 > 0) as synced from documents group by 1) select *, total - synced as missing, round(synced / total::double * 100, 1) as rate from g where total > synced")
P.add(
    "c27_sync_status", lambda s, d: op.sync_status(table(s, d, "documents").select(F.col("source").alias("ticker")), table(s, d, "documents").filter("doc_id % 5 > 0").select(F.col("source").alias("ticker"))),
    "with g as (select source as ticker, count(*) as n_source, count(*) filter (where doc_id % 5 > 0) as n_exported from documents group by 1) select *, n_source - n_exported as delta, n_source <> n_exported as needs_sync from g",
)
P.add(
    "d13_coverage", lambda s, d: op.coverage(filings(s, d), insiders(s, d).filter("code = '1'"), holdings(s, d).withColumnRenamed("cusip", "ticker")),
    """with f as (select ticker, count(*) as filings, count(*) filter (where form = '10-K') as annual, max(filing_date) as d1 from filings group by 1), i as (select ticker, count(*) as insiders, max(transaction_date) as d2 from insiders where code = '1' group by 1), h as (select cusip as ticker, count(*) as holdings, max(report_date) as d3 from holdings group by 1)
    select ticker, coalesce(filings, 0) as filings, coalesce(annual, 0) as annual, coalesce(insiders, 0) as insiders, coalesce(holdings, 0) as holdings, greatest(d1, d2, d3) as updated from f full join i using (ticker) full join h using (ticker)""", FILINGS, INSIDERS, HOLDINGS,
)
P.add(
    "c31_deal_list", lambda s, d: (lambda c: op.deal_list(table(s, d, "region").select(F.col("r_regionkey").alias("deal")), c.select("conv_id", (F.col("conv_id") % 4).cast("int").alias("deal")).distinct(), c))(table(s, d, "conversations")),
    "with n as (select conv_id, count(*) as n from conversations group by 1), p as (select conv_id % 4 as deal, count(*) as sessions, sum(n)::bigint as messages from n group by 1) select r_regionkey as deal, coalesce(sessions, 0) as sessions, coalesce(messages, 0) as messages from region left join p on deal = r_regionkey",
)
P.add(
    "d34_vocabulary", lambda s, d: op.vocabulary(facts(s, d)),
    "with x as (select distinct metric, ticker from facts qualify dense_rank() over (partition by metric order by ticker) <= 5) select metric, count(*) as n, count(distinct ticker) as tickers, (select string_agg(ticker, ',' order by ticker) from x where x.metric = facts.metric) as sample from facts group by metric", FACTS,
)
P.add(
    "d27_verify_totals", lambda s, d: op.verify_totals(holdings(s, d).select(F.col("holder").alias("accession"), F.col("market_value").alias("value")), table(s, d, "supplier").select(F.col("s_suppkey").alias("accession"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(100)).cast("long").alias("stated_n"), F.lit(500.0).alias("stated_thousands"))),
    """select holder as accession, count(*) as n, sum(market_value::decimal(30,2))::double as total, case when holder % 2 = 0 then count(*) = 100 else true end as count_ok, abs(sum(market_value::decimal(30,2))::double - 500000) <= 1000 as sum_ok, case when holder % 2 = 1 then 'no control total' end as note from holdings group by holder""", HOLDINGS,
)

# --- filings, holdings, insiders -----------------------------------------------------

P.add(
    "c21_latest_quarter", lambda s, d: (lambda h: h.join(h.groupBy("cusip").agg(F.max_by("quarter", "report_date").alias("quarter")), ["cusip", "quarter"]).select("cusip", "holder", "quarter", "shares"))(holdings(s, d)),
    "select cusip, holder, quarter, shares from holdings qualify report_date = max(report_date) over (partition by cusip)", HOLDINGS,
)
P.add(
    "f5_top_holders", lambda s, d: (lambda h: ranked(h.join(h.groupBy("cusip").agg(F.max("report_date").alias("report_date")), ["cusip", "report_date"]), ["cusip"], F.desc("market_value"), "holder", top=2).select("cusip", "holder", "market_value"))(holdings(s, d)),
    "with l as (select * from holdings qualify report_date = max(report_date) over (partition by cusip)) select cusip, holder, market_value from l qualify row_number() over (partition by cusip order by market_value desc, holder) <= 2", HOLDINGS,
)
P.add("b14_recent_insiders", lambda s, d: ranked(insiders(s, d).filter("code in ('1', '2') and transaction_date >= date '1996-01-01'"), ["ticker"], F.desc("transaction_date"), "accession", top=3), "select * from insiders where code in ('1', '2') and transaction_date >= date '1996-01-01' qualify row_number() over (partition by ticker order by transaction_date desc, accession) <= 3", INSIDERS)
P.add(
    "i16_narratives", lambda s, d: ranked(insiders(s, d), ["ticker"], F.desc("transaction_date"), "accession", top=3).groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_list(F.format_string("%s: %s %d", F.col("transaction_date").cast("string"), F.when(F.col("code") == "1", "bought").when(F.col("code") == "2", "sold").otherwise("moved"), F.floor("amount")))), "; ").alias("text")),
    """with l as (select *, transaction_date::varchar || ': ' || case code when '1' then 'bought' when '2' then 'sold' else 'moved' end || ' ' || floor(amount)::bigint as line from insiders qualify row_number() over (partition by ticker order by transaction_date desc, accession) <= 3)
    select ticker, string_agg(line, '; ' order by line) as text from l group by 1""", INSIDERS,
)
P.add("a6_list_filings", lambda s, d: filings(s, d).filter("filing_date between date '1995-06-01' and date '1997-06-01' and (form = '10-K' or startswith(form, '10-K/') or form = 'NT 10-K')").groupBy("form").agg(F.count("*").alias("n")), "select form, count(*) as n from filings where filing_date between date '1995-06-01' and date '1997-06-01' and (form = '10-K' or form like '10-K/%' or form = 'NT 10-K') group by 1", FILINGS)
P.add("c12_new_filings", lambda s, d: filings(s, d).join(filings(s, d).filter("accession % 3 = 0").select("ticker", "accession"), ["ticker", "accession"], "left_anti").select("ticker", "accession"), "select ticker, accession from filings where accession % 3 <> 0", FILINGS)
P.add(
    "c13_notify", lambda s, d: filings(s, d).filter("form = '8-K'").join(table(s, d, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_nationkey") % 5).alias("tenant_id")).distinct(), "ticker").select("tenant_id", "ticker", "accession"),
    "select c_nationkey % 5 as tenant_id, ticker, accession from filings join customer on c_custkey = ticker where form = '8-K'", FILINGS,
)


def prior_filings(new, old, n=2):
    """C22. As-of: the ``n`` filings of the ticker before each new one. Both sides meet
    by ticker in one sorted window, so no range join multiplies rows."""
    from pyspark.sql import Window as W

    both = new.select("ticker", "accession", "filing_date", F.lit(True).alias("new")).unionByName(old.select("ticker", "accession", "filing_date", F.lit(False).alias("new")))
    before = W.partitionBy("ticker").orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    item = F.when(~F.col("new"), F.struct("filing_date", "accession"))
    w = both.withColumn("day", F.unix_date("filing_date")).withColumn("_p", F.max(item).over(before))
    out = w.filter("new").select("ticker", "accession", F.col("_p.accession").alias("prior"), F.col("_p.filing_date").alias("prior_date"))
    return out


P.add(
    "c22_prior_filing", lambda s, d: prior_filings(filings(s, d).filter("form = '10-K'"), filings(s, d).filter("form <> '10-K'")),
    "with p as (select n.ticker, n.accession, max((o.filing_date, o.accession)) as m from filings n left join filings o on o.ticker = n.ticker and o.form <> '10-K' and o.filing_date < n.filing_date where n.form = '10-K' group by 1, 2) select ticker, accession, m[2] as prior, m[1] as prior_date from p", FILINGS,
)
P.add("n4_event_filings", lambda s, d: filings(s, d).filter("form = '8-K' and filing_date between date '1996-01-01' and date '1996-12-31'").select("ticker", "filing_date").distinct(), "select distinct ticker, filing_date from filings where form = '8-K' and filing_date between date '1996-01-01' and date '1996-12-31'", FILINGS)
P.add(
    "c34_eligible", lambda s, d: filings(s, d).groupBy("ticker").agg(F.collect_set("form").alias("forms")).select("ticker", F.explode(F.array_compact(F.array(F.when(F.arrays_overlap("forms", F.array(F.lit("10-K"), F.lit("10-Q"))), "trend"), F.when(F.array_contains("forms", "8-K"), "events")))).alias("item")),
    "select distinct ticker, case when form = '8-K' then 'events' else 'trend' end as item from filings where form in ('10-K', '10-Q', '8-K')", FILINGS,
)
P.add("a5_with_cik", lambda s, d: table(s, d, "customer").select("c_custkey", F.lpad(F.regexp_replace("c_name", "[^0-9]", ""), 10, "0").alias("cik")), "select c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 10, '0') as cik from customer")
P.add("f6_page", lambda s, d: table(s, d, "part").orderBy("p_name", "p_partkey").offset(20).limit(10).select("p_partkey", "p_name").withColumn("total", F.lit(table(s, d, "part").count())), "select p_partkey, p_name, (select count(*) from part) as total from part order by p_name, p_partkey limit 10 offset 20")
P.add("f1_prioritise", lambda s, d: log(s, d).withColumn("severity", F.when(F.col("method") == "error", "high").when(F.col("latency") > 50, "medium").otherwise("low")).groupBy("severity", "method").agg(F.count("*").alias("n")).orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "method"), "select case when method = 'error' then 'high' when latency > 50 then 'medium' else 'low' end as severity, method, count(*) as n from log group by 1, 2", LOG)
P.add("h28_json_field", lambda s, d: log(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "select event_id, (props->>'$.k')::int as k from log", LOG)
