"""Queries over fact tables (V1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import facts as op
from tallyfold.operators import series as ts
from tallyfold.plans.base import Plans
from tallyfold.sources.bindings import FACTS, facts

P = Plans()
KEY = """case when regexp_matches(fiscal_period, '^Q[1-4] ') then right(fiscal_period, 4)::int * 10000 + substring(fiscal_period, 2, 1)::int * 100
  when regexp_matches(fiscal_period, '^FY') then right(fiscal_period, 4)::int * 10000 else 0 end"""
COLS = "ticker, metric, raw_label, value, fiscal_period, period_type, filing_type, statement_type, filing_date, statement_date, confidence"
SYNONYMS = [("revenue", "Net Sales"), ("revenue", "revenue"), ("net_income", "NET_INCOME"), ("units", "units"), ("net_income", "profit")]


def synonyms(spark):
    return spark.createDataFrame(SYNONYMS, "canonical string, name string")


P.add("a4_frame", lambda s, d: facts(s, d).filter("metric = 'revenue' and fiscal_period = 'FY1997'").select("ticker", "value"), "select ticker, value from facts where metric = 'revenue' and fiscal_period = 'FY1997'", FACTS)
P.add("b1_query_facts", lambda s, d: op.query_facts(facts(s, d), metric="revenue", form="10-K", start="1997-01-01"), f"select {COLS} from facts where metric = 'revenue' and filing_type = '10-K' and filing_date >= date '1997-01-01' order by filing_date desc, metric, ticker, fiscal_period, filing_type limit 100", FACTS)
P.add(
    "b2_retrieve", lambda s, d: op.retrieve(facts(s, d), synonyms(s), s.createDataFrame([("PROFIT",), ("nothing",)], "name string"), forms=["10-K"]),
    f"select {COLS} from facts where lower(metric) in ('net_income', 'profit') and filing_type = '10-K' order by ticker, metric, fiscal_period desc, filing_type limit 100", FACTS,
)
P.add("b3_period_range", lambda s, d: facts(s, d).filter(F.array_contains(F.array(*(F.lit(f"FY{y}") for y in range(1996, 1999))), F.col("fiscal_period"))).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts where fiscal_period in ('FY1996', 'FY1997', 'FY1998')", FACTS)
P.add("b4_match_periods", lambda s, d: op.match_periods(facts(s, d), ["FY1998", "q2 1999"]).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts where replace(lower(fiscal_period), 'fy', '') like '%1998%' or lower(fiscal_period) like '%q2 1999%'", FACTS)
P.add(
    "b6_quality_filter", lambda s, d: op.quality_filter(facts(s, d), s.createDataFrame([("revenue",), ("units",)], "metric string"), {"net_income": ["net_income"]}).select("ticker", "metric", "fiscal_period", "value"),
    "select ticker, metric, fiscal_period, value from facts where metric in ('revenue', 'units') or (confidence >= 1 and metric = 'net_income') or confidence >= 0.7", FACTS,
)
P.add("b7_validate_results", lambda s, d: op.validate_results(facts(s, d)).select("ticker", "metric", "fiscal_period", "value", "note"), "select ticker, metric, fiscal_period, value, null::varchar as note from facts where value is not null and confidence >= 0.7", FACTS)
P.add("b8_plausible_periods", lambda s, d: op.plausible_periods(facts(s, d)).groupBy("fiscal_period").count(), 'select fiscal_period, count(*) as "count" from facts group by 1', FACTS)
P.add("b9_chartable", lambda s, d: op.chartable(facts(s, d)).groupBy("filing_type").agg(F.count("*").alias("n")), "select filing_type, count(*) as n from facts where regexp_full_match(fiscal_period, '(FY\\d{4}|Q[1-4] \\d{4})') group by 1", FACTS)
P.add("b13_scope_facts", lambda s, d: op.scope_facts(facts(s, d), "1996-01-01", "1997-12-31", ["units"]).select("ticker", "fiscal_period", "value"), "select ticker, fiscal_period, value from facts where statement_date between date '1996-01-01' and date '1997-12-31' and metric = 'units'", FACTS)
P.add("b16_facts_by_concept", lambda s, d: op.facts_by_concept(facts(s, d), "Income").groupBy("raw_label").agg(F.count("*").alias("n")), "select raw_label, count(*) as n from facts where lower(raw_label) like '%income%' group by 1", FACTS)
P.add(
    "d1_summary", lambda s, d: op.summary(facts(s, d)),
    "select ticker, metric, count(*) as n, sum(value::decimal(20,2))::double as total from facts group by grouping sets ((ticker), (metric), ())", FACTS,
)
P.add("d2_ticker_stats", lambda s, d: op.ticker_stats(facts(s, d)), "select ticker, count(*) as n, max(filing_date) as latest_date, max_by(filing_type, (filing_date, filing_type)) as latest_form from facts group by 1", FACTS)
P.add(
    "d3_metric_stats", lambda s, d: op.metric_stats(facts(s, d)),
    "select metric, count(*) as n, max_by(value, (filing_date, fiscal_period, ticker)) as latest_value, max_by(fiscal_period, (filing_date, fiscal_period, ticker)) as latest_period, max(filing_date) as latest_date from facts group by 1", FACTS,
)
P.add(
    "d4_periods", lambda s, d: op.periods(facts(s, d)),
    f"""with k as (select distinct ticker, {KEY} as k from facts), p as (select ticker, k // 10000 as year, (k % 10000) // 100 as quarter from k)
    select ticker, year, bool_or(quarter = 0) as annual, coalesce(string_agg(quarter::varchar, ',' order by quarter) filter (where quarter > 0), '') as quarters from p group by 1, 2""", FACTS,
)
P.add(
    "d32_computable", lambda s, d: __import__("tallyfold.operators.ratios", fromlist=["computable"]).computable(facts(s, d), {"gross_margin": ["revenue", "cost_of_revenue"], "fcf": ["operating_cash_flow", "capital_expenditure"], "net_margin": ["net_income", "revenue"]}),
    "select distinct ticker, unnest(['gross_margin', 'net_margin']) as metric from facts", FACTS,
)
P.add("e1_first_per", lambda s, d: op.first_per(facts(s, d), ["ticker"], F.desc("confidence"), F.desc("value"), "metric", "fiscal_period").select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts qualify row_number() over (partition by ticker order by confidence desc, value desc, metric, fiscal_period) = 1", FACTS)
P.add("e2_snapshot", lambda s, d: op.snapshot(facts(s, d)).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts qualify filing_date = max(filing_date) over (partition by ticker)", FACTS)
P.add("e3_series", lambda s, d: op.series(facts(s, d), 3).select("ticker", "metric", "filing_type", "fiscal_period", "value"), f"select ticker, metric, filing_type, fiscal_period, value from facts qualify row_number() over (partition by ticker, metric, filing_type order by {KEY} desc, filing_date desc) <= 3", FACTS)
P.add("e4_dedupe_best", lambda s, d: op.dedupe_best(facts(s, d)).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts qualify row_number() over (partition by ticker, lower(metric), fiscal_period order by confidence desc, value desc, filing_type) = 1", FACTS)
P.add("e5_dedupe_confidence", lambda s, d: op.dedupe_confidence(facts(s, d)).groupBy("filing_type").agg(F.count("*").alias("n")), "select filing_type, count(*) as n from (select distinct ticker, metric, fiscal_period, filing_type from facts) group by 1", FACTS)
P.add("e6_dedupe_newest", lambda s, d: op.dedupe_newest(facts(s, d)).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, coalesce(value, 0) as value from facts qualify row_number() over (partition by ticker, metric, fiscal_period order by filing_date desc, value desc, filing_type) = 1", FACTS)
P.add("e7_period_values", lambda s, d: op.period_values(facts(s, d), "10-Q", ["revenue"], 100000.0).select("ticker", "metric", "fiscal_period", "value"), "select ticker, metric, fiscal_period, value from facts where filing_type = '10-Q' and confidence >= 0.8 and abs(value) >= case when metric = 'revenue' then 100000 else 0 end", FACTS)
P.add(
    "e9_latest_bundle", lambda s, d: op.latest_bundle(facts(s, d), ["revenue", "net_income"]).select("ticker", "metric", "filing_type", "fiscal_period", "value", "rank"),
    f"select ticker, metric, filing_type, fiscal_period, value, row_number() over (partition by ticker, metric, filing_type order by {KEY} desc, confidence desc, value desc)::int as rank from facts where metric in ('revenue', 'net_income') qualify rank <= case filing_type when '10-K' then 5 else 1 end", FACTS,
)
P.add(
    "e11_compare", lambda s, d: op.compare(facts(s, d), ["revenue", "net_income", "units"]),
    f"""with l as (select ticker, metric, value from facts where metric in ('revenue', 'net_income', 'units') qualify row_number() over (partition by ticker, metric order by filing_date desc, {KEY} desc, filing_type) = 1)
    select ticker, max(value) filter (where metric = 'revenue') as revenue, max(value) filter (where metric = 'net_income') as net_income, max(value) filter (where metric = 'units') as units from l group by 1""", FACTS,
)


def _fallback(s, d):
    f = facts(s, d)
    docs = f.filter("metric = 'units' and filing_type = '10-K'").select("ticker", F.lit("headcount").alias("metric"), "fiscal_period", "value", F.col("statement_date").alias("period_end"), F.col("filing_date").alias("created"), (F.col("confidence") > 0.8).alias("verified"))
    return op.with_fallback(f.filter("metric = 'units'"), docs)


P.add(
    "e10_with_fallback", _fallback,
    """select ticker, metric, fiscal_period, value, confidence from facts where metric = 'units'
    union all (select ticker, 'headcount', fiscal_period, value, case when confidence > 0.8 then 0.95 else 0.75 end from facts where metric = 'units' and filing_type = '10-K' qualify row_number() over (partition by ticker order by statement_date desc, value desc) = 1)""", FACTS,
)
P.add("g3_merge_metrics", lambda s, d: (lambda f: op.merge_metrics(f.filter("metric = 'revenue' and filing_type = '10-K'"), f.filter("metric = 'revenue'"), ["ticker", "metric", "fiscal_period"]))(facts(s, d).select("ticker", "metric", "fiscal_period", "filing_type", "value")), "select ticker, metric, fiscal_period, filing_type, value from facts where metric = 'revenue'", FACTS)
P.add(
    "g4_audit_sets", lambda s, d: (lambda f: op.audit_sets(f.filter("value > 100000"), f.filter("filing_type = '10-K'"), ["ticker", "metric", "fiscal_period"]))(facts(s, d)),
    """with x as (select distinct ticker, metric, fiscal_period from facts where value > 100000), y as (select distinct ticker, metric, fiscal_period from facts where filing_type = '10-K'),
    j as (select coalesce(x.ticker, y.ticker) as ticker, x.ticker is not null as inx, y.ticker is not null as iny from x full join y using (ticker, metric, fiscal_period)),
    n as (select ticker, count(*) filter (where not iny) as extra, count(*) filter (where not inx) as missing, count(*) filter (where inx and iny) as common from j group by 1)
    select *, round(common / nullif(common + missing, 0)::double, 6) as share from n""", FACTS,
)

# --- series --------------------------------------------------------------------------

TTM = f"""with q as (select ticker, metric, fiscal_period, value, confidence, {KEY} as key from facts where filing_type = '10-Q' qualify row_number() over (partition by ticker, metric order by key desc) <= 4)
select ticker, metric, sum(value::decimal(20,2))::double as value, count(value) as quarters, max_by(fiscal_period, key) as last_quarter, min(confidence) as confidence{{}} from q group by 1, 2{{}}"""
P.add("e12_ttm", lambda s, d: ts.ttm(facts(s, d)), TTM.format("", " having count(value) = 4"), FACTS)
P.add("e13_ltm", lambda s, d: ts.ltm(facts(s, d)), TTM.format(", count(value) < 4 as incomplete", ""), FACTS)
P.add(
    "e12_rolling_ttm", lambda s, d: ts.rolling_ttm(facts(s, d)),
    f"""with q as (select ticker, metric, fiscal_period, sum(value::decimal(20,2)) over w as ttm, count(value) over w as n from (select *, {KEY} as key from facts where filing_type = '10-Q') window w as (partition by ticker, metric order by key rows between 3 preceding and current row))
    select ticker, metric, fiscal_period, ttm::double as ttm from q where n = 4""", FACTS,
)
P.add(
    "e14_ttm_chain", lambda s, d: ts.ttm_chain(facts(s, d)),
    """with recursive q as (select ticker, metric, statement_date as e, value::decimal(20,2) as v, row_number() over (partition by ticker, metric order by statement_date desc) as rn from facts where filing_type = '10-Q'),
    c as (select ticker, metric, e, v, rn, 1 as n, v::decimal(30,2) as total, e as last_end from q where rn = 1
      union all select c.ticker, c.metric, q.e, q.v, q.rn, case when c.n < 4 and c.last_end - q.e between 80 and 110 then c.n + 1 else c.n end, (case when c.n < 4 and c.last_end - q.e between 80 and 110 then c.total + q.v else c.total end)::decimal(30,2),
        case when c.n < 4 and c.last_end - q.e between 80 and 110 then q.e else c.last_end end from c join q on q.ticker = c.ticker and q.metric = c.metric and q.rn = c.rn + 1 where c.rn < 16)
    select ticker, metric, max(n)::int as links, max(case when n = 4 then total end)::double as ttm from c group by 1, 2""", FACTS,
)


def spans(s, d):
    f = facts(s, d).filter("metric = 'revenue'")
    start = F.when(F.col("filing_type") == "10-K", F.add_months(F.date_add("statement_date", 1), -12)).otherwise(F.add_months(F.date_add("statement_date", 1), -3))
    return f.select("ticker", "metric", "value", start.alias("start"), F.col("statement_date").alias("end"))


P.add("e15_pick_fy", lambda s, d: ts.pick_fy(spans(s, d)).select("ticker", "metric", "end", "value"), "select ticker, metric, statement_date as \"end\", value from facts where metric = 'revenue' and filing_type = '10-K' qualify row_number() over (partition by ticker order by statement_date desc) = 1", FACTS)
P.add("e15_pick_quarters", lambda s, d: ts.pick_quarters(spans(s, d)).select("ticker", "metric", "end", "value"), "select ticker, metric, statement_date as \"end\", value from facts where metric = 'revenue' and filing_type = '10-Q'", FACTS)
P.add(
    "e16_resolve_by_priority", lambda s, d: ts.resolve_by_priority(facts(s, d), s.createDataFrame([("sales", "net_sales", 1, 1), ("sales", "revenue", 2, 1), ("sales", "gross_sales", 3, 1), ("cost", "cost_of_revenue", 1, -1)], "target string, metric string, priority int, sign int")),
    "select ticker, fiscal_period, filing_type, 'sales' as target, metric, value, 2 as attempts from facts where metric = 'revenue' union all select ticker, fiscal_period, filing_type, 'cost', metric, -value, 1 from facts where metric = 'cost_of_revenue'", FACTS,
)
YOY = f"""y as (select ticker, metric, fiscal_period, value, lag(value) over (partition by ticker, metric order by {KEY}) as previous from facts where filing_type = '10-K'),
yoy as (select *, round((value - previous) / nullif(abs(previous), 0), 6) as yoy from y)"""
P.add("e17_yoy", lambda s, d: ts.yoy(facts(s, d)), "select * from yoy", FACTS, YOY)
P.add("e17_avg_yoy", lambda s, d: ts.avg_yoy(facts(s, d)), "select ticker, metric, round(avg(yoy), 5) as avg_yoy, count(yoy) as n from yoy group by 1, 2", FACTS, YOY)
P.add(
    "e18_cagr", lambda s, d: ts.cagr(facts(s, d)),
    f"""with l as (select ticker, metric, value, {KEY} as key from facts where filing_type = '10-K' qualify row_number() over (partition by ticker, metric order by key desc) <= 6),
    e as (select ticker, metric, min_by(value, key) as a, max_by(value, key) as b, ((max(key) - min(key)) // 10000)::int as years, count(*) as n from l group by 1, 2)
    select ticker, metric, years, case when n >= 2 and a > 0 and b > 0 then round(pow(b / a, 1.0 / years) - 1, 6) end as cagr from e""", FACTS,
)
P.add(
    "e19_margin_trend", lambda s, d: ts.margin_trend(facts(s, d)),
    f"""with w as (select ticker, {KEY} as key, max(value) filter (where metric = 'net_income') / nullif(max(value) filter (where metric = 'revenue'), 0) as m from facts where filing_type = '10-K' group by 1, 2),
    t as (select ticker, round((max_by(m, key) - min_by(m, key)) / count(*), 6) as trend, count(*) as n from w where m is not null group by 1) select *, trend > 0 as improving from t""", FACTS,
)
P.add(
    "e20_zscore_outliers", lambda s, d: ts.zscore_outliers(facts(s, d), limit=1.0),
    f"""with z as (select ticker, metric, fiscal_period, value, {KEY} as key, count(value) over w as n, avg(value) over w as m, stddev_pop(value) over w as sd, max(key) over w as newest from facts where filing_type = '10-Q' window w as (partition by ticker, metric)),
    r as (select ticker, metric, fiscal_period, value, round((value - m) / sd, 4) as z from z where n >= 4 and sd > 0 and key = newest)
    select *, case when abs(z) > 3 then 'high' when abs(z) > 2.5 then 'medium' else 'low' end as severity from r where abs(z) > 1""", FACTS,
)
P.add(
    "e21_range_check", lambda s, d: (lambda f: ts.range_check(f.filter("fiscal_period = 'FY2000'"), f.filter("filing_type = '10-Q' and fiscal_period not like '%2001'")).select("ticker", "metric", "value", "out_of_range", "checked_confidence"))(facts(s, d)),
    f"""with h as (select ticker, metric, value from facts where filing_type = '10-Q' and fiscal_period not like '%2001' qualify row_number() over (partition by ticker, metric order by {KEY} desc) <= 8),
    a as (select ticker, metric, count(value) as n, avg(value) as m, stddev_pop(value) as sd from h group by 1, 2),
    j as (select f.ticker, f.metric, f.value, f.confidence, coalesce(n >= 3 and ((sd > 0 and abs(value - m) > 5 * sd) or (sd = 0 and value <> m)), false) as o from facts f left join a using (ticker, metric) where fiscal_period = 'FY2000')
    select ticker, metric, value, o as out_of_range, case when o then 0.3 else confidence end as checked_confidence from j""", FACTS,
)
P.add(
    "e22_streaks", lambda s, d: ts.streaks(facts(s, d), least=2),
    f"""with v as (select ticker, metric, fiscal_period, {KEY} as key, value, lag(value) over (partition by ticker, metric order by key) as p, count(*) over (partition by ticker, metric) as n from facts where filing_type = '10-Q'),
    s as (select *, case when value > p * 1.05 then 'up' when value < p * 0.95 then 'down' else 'flat' end as dir from v where p is not null and n >= 5),
    w as (select *, first(dir) over (partition by ticker, metric order by key desc) as newest from s), b as (select *, sum((dir <> newest)::int) over (partition by ticker, metric order by key desc) as breaks from w)
    select ticker, metric, newest as direction, count(*) as run, max_by(fiscal_period, key) as fiscal_period from b where breaks = 0 group by 1, 2, 3 having count(*) >= 2""", FACTS,
)
P.add(
    "e23_reversals", lambda s, d: ts.reversals(facts(s, d)),
    f"""with v as (select ticker, metric, fiscal_period, {KEY} as key, value, lag(value) over w as p1, lag(value, 2) over w as p2, max(key) over (partition by ticker, metric) as newest from facts where filing_type = '10-K' window w as (partition by ticker, metric order by key)),
    c as (select *, (value - p1) / nullif(abs(p1), 0) as ch, (p1 - p2) / nullif(abs(p2), 0) as be from v where key = newest)
    select ticker, metric, fiscal_period, round(be, 6) as before, round(ch, 6) as change from c where sign(ch) * sign(be) < 0 and abs(ch) > 0.05 and abs(be) > 0.05""", FACTS,
)
P.add(
    "e33_chart_series", lambda s, d: ts.chart_series(facts(s, d), "revenue"),
    f"""with v as (select ticker, fiscal_period, {KEY} as key, value from facts where metric = 'revenue' and filing_type = '10-K'), g as (select * from (select distinct ticker from v), (select distinct fiscal_period, key from v)),
    j as (select ticker, fiscal_period, key, value, lag(value) over (partition by ticker order by key) as p from g left join v using (ticker, fiscal_period, key)) select ticker, fiscal_period, value, round((value - p) / nullif(abs(p), 0), 6) as yoy from j""", FACTS,
)
