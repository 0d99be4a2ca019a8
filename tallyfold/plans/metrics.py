"""Queries for derived metrics, peers, hierarchies and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import access, hierarchy, peers, ratios
from tallyfold.operators.facts import ranked
from tallyfold.operators.series import ttm
from tallyfold.plans.base import Plans
from tallyfold.plans.facts import KEY
from tallyfold.sources.bindings import FACTS, PEERS, TENANTS, TREE, facts, peer_facts, table, tenants, tree

P = Plans()
WIDE = """wide_f as (
  select ticker, fiscal_period, filing_type, max(value) filter (where metric = 'revenue') as revenue, max(value) filter (where metric = 'gross_sales') as gross_sales, max(value) filter (where metric = 'cost_of_revenue') as cost_of_revenue,
    max(value) filter (where metric = 'operating_expenses') as operating_expenses, max(value) filter (where metric = 'income_tax_expense') as income_tax_expense, max(value) filter (where metric = 'net_income') as net_income, max(value) filter (where metric = 'units') as units
  from facts group by 1, 2, 3
)"""
# balance-sheet names for the measures the driver's tables have
AS_BALANCE = {"gross_sales": "total_assets", "revenue": "current_assets", "cost_of_revenue": "current_liabilities", "operating_expenses": "inventory", "income_tax_expense": "accounts_receivable", "units": "accounts_payable"}


def balance_facts(s, d):
    """Facts and, beside them, the same values under balance-sheet names."""
    f = facts(s, d)
    name = F.create_map(*(F.lit(x) for kv in AS_BALANCE.items() for x in kv))[F.col("metric")]
    return f.unionByName(f.withColumn("metric", name).filter("metric is not null"))


P.add("c14_combine", lambda s, d: ratios.combine(facts(s, d), "gross_margin", ["net_sales", "revenue"], ["cost_of_revenue"], lambda a, b: F.round((a - b) / F.nullif(a, F.lit(0.0)), 6)), "select ticker, fiscal_period, filing_type, 'gross_margin' as metric, round((revenue - cost_of_revenue) / nullif(revenue, 0), 6) as value, revenue as \"left\", cost_of_revenue as \"right\" from wide_f", FACTS, WIDE)
PREV = """prev as (
  select f.ticker, f.fiscal_period, f.filing_type, f.metric, f.value, p.value as previous, coalesce(p.value <> 0, false) as has_previous from facts f left join facts p on p.ticker = f.ticker and p.metric = f.metric and p.filing_type = f.filing_type
    and p.fiscal_period = case when f.fiscal_period like 'FY%' then 'FY' || (right(f.fiscal_period, 4)::int - 1) when f.fiscal_period like 'Q1%' then 'Q4 ' || (right(f.fiscal_period, 4)::int - 1) else 'Q' || (substring(f.fiscal_period, 2, 1)::int - 1) || ' ' || right(f.fiscal_period, 4) end
), changes as (
  select ticker, fiscal_period, filing_type, metric, value, previous, case when previous is not null then round(value - previous, 2) else 0 end as change, case when has_previous then round((value - previous) / abs(previous) * 100, 4) else 0 end as change_pct, has_previous from prev
), vs as (select *, case when change_pct > 1 then 'up' when change_pct < -1 then 'down' else 'flat' end as trend from changes)"""
P.add("c15_vs_previous", lambda s, d: ratios.vs_previous(facts(s, d)), "select * from vs", FACTS, PREV)
P.add("f2_hero", lambda s, d: ratios.hero(facts(s, d), ["net_income", "revenue"], "FY1998", 4).select("ticker", "metric", "value", "change_pct"), "select ticker, metric, value, change_pct from vs where fiscal_period = 'FY1998' qualify row_number() over (partition by ticker order by (metric in ('net_income', 'revenue')) desc, abs(value) desc, metric) <= 4", FACTS, PREV)
P.add(
    "c28_market_cap", lambda s, d: ratios.market_cap(facts(s, d), table(s, d, "supplier").select(F.col("s_name").alias("ticker"), F.col("s_acctbal").alias("price")), "units", "net_income"),
    "select ticker, fiscal_period, filing_type, round(units * s_acctbal, 2) as market_cap, round(net_income / nullif(units * s_acctbal, 0), 6) as cash_yield from wide_f join supplier on s_name = ticker", FACTS, WIDE,
)
P.add("m1_ebitda", lambda s, d: ratios.ebitda(facts(s, d)), "select ticker, fiscal_period, filing_type, round(net_income + abs(income_tax_expense) + 0 + 0, 2) as ebitda, round((net_income + abs(income_tax_expense) + 0 + 0) / nullif(revenue, 0), 6) as ebitda_margin from wide_f", FACTS, WIDE)
P.add(
    "m2_fcf", lambda s, d: ratios.fcf(facts(s, d).withColumn("metric", F.when(F.col("metric") == "gross_sales", "operating_cash_flow").when(F.col("metric") == "operating_expenses", "capital_expenditure").otherwise(F.col("metric")))),
    "select ticker, fiscal_period, filing_type, round(gross_sales - abs(operating_expenses), 2) as fcf, round((gross_sales - abs(operating_expenses)) / nullif(net_income, 0), 6) as cash_conversion, round(abs(operating_expenses) / nullif(revenue, 0), 6) as capex_share from wide_f", FACTS, WIDE,
)
P.add(
    "m3_margins", lambda s, d: ratios.margins(facts(s, d)),
    """with g as (select *, revenue - cost_of_revenue as gp, revenue - cost_of_revenue - operating_expenses as oi from wide_f)
    select ticker, fiscal_period, filing_type, round(gp, 2) as gross_profit, round(gp / nullif(revenue, 0), 6) as gross_margin, round(oi, 2) as operating_income, round(oi / nullif(revenue, 0), 6) as operating_margin, net_income, round(net_income / nullif(revenue, 0), 6) as net_margin from g""", FACTS, WIDE,
)
P.add(
    "m4_working_capital", lambda s, d: ratios.working_capital(balance_facts(s, d)),
    """with w as (select *, income_tax_expense / nullif(revenue, 0) * 365 as a, operating_expenses / nullif(cost_of_revenue, 0) * 365 as b, units / nullif(cost_of_revenue, 0) * 365 as c from wide_f)
    select ticker, fiscal_period, filing_type, round(a, 4) as dso, round(b, 4) as dio, round(c, 4) as dpo, round(a + b - c, 4) as cash_cycle from w""", FACTS, WIDE,
)
P.add(
    "m5_balance_ratios", lambda s, d: ratios.balance_ratios(balance_facts(s, d)),
    """select ticker, fiscal_period, filing_type, round(revenue / nullif(cost_of_revenue, 0), 6) as current_ratio, round((revenue - operating_expenses) / nullif(cost_of_revenue, 0), 6) as quick_ratio, round(revenue - cost_of_revenue, 2) as working_capital,
    null::double as debt_to_equity, null::double as roe, round(revenue / nullif(gross_sales, 0), 6) as asset_turnover from wide_f""", FACTS, WIDE,
)
P.add(
    "m6_fill_derived", lambda s, d: ratios.fill_derived(facts(s, d)),
    "select ticker, fiscal_period, filing_type, metric, value, confidence, false as derived from facts union all select ticker, fiscal_period, filing_type, 'gross_profit', round(revenue - cost_of_revenue, 2), 0.85, true from wide_f", FACTS, WIDE,
)
P.add(
    "m7_metrics_summary", lambda s, d: (lambda m: m.select("ticker", "n_years", "latest_revenue", F.expr("round(aggregate(years, 0D, (a, y) -> a + y.net_margin), 4)").alias("margin_sum")))(ratios.metrics_summary(facts(s, d))),
    "select ticker, count(*) as n_years, max_by(revenue, fiscal_period) as latest_revenue, round(list_sum(list(round(net_income / nullif(revenue, 0), 6) order by fiscal_period)), 4) as margin_sum from wide_f where filing_type = '10-K' group by 1", FACTS, WIDE,
)
FORMULAS = {"gross_margin": "(revenue - cost_of_revenue) / revenue", "tax_rate": "abs(income_tax_expense) / (net_income + income_tax_expense)", "odd": "max(revenue, units) / min(units - units, 1)"}
P.add(
    "m8_evaluate", lambda s, d: ratios.evaluate(facts(s, d), FORMULAS),
    """select ticker, fiscal_period, filing_type, 'gross_margin' as metric, round((revenue - cost_of_revenue) / nullif(revenue, 0), 6) as value, case when revenue = 0 then 'division by zero' end as reason, '(revenue - cost_of_revenue) / revenue' as formula from wide_f
    union all select ticker, fiscal_period, filing_type, 'tax_rate', round(abs(income_tax_expense) / nullif(net_income + income_tax_expense, 0), 6), case when net_income + income_tax_expense = 0 then 'division by zero' end, 'abs(income_tax_expense) / (net_income + income_tax_expense)' from wide_f
    union all select ticker, fiscal_period, filing_type, 'odd', null, 'division by zero', 'max(revenue, units) / min(units - units, 1)' from wide_f""", FACTS, WIDE,
)
P.add(
    "m9_resolve_computed", lambda s, d: ratios.resolve_computed(facts(s, d), {"gross": "revenue - cost_of_revenue", "margin": "gross / revenue", "spread": "margin - 0.1"}, [["gross"], ["margin"], ["spread"]]),
    "select ticker, fiscal_period, filing_type, round(revenue - cost_of_revenue, 6) as gross, round((revenue - cost_of_revenue) / nullif(revenue, 0), 6) as margin, round((revenue - cost_of_revenue) / nullif(revenue, 0) - 0.1, 6) as spread from wide_f", FACTS, WIDE,
)


def _checked(s, d):
    f = facts(s, d)
    gross = f.filter("metric = 'units'").withColumn("metric", F.lit("gross_profit"))
    return ratios.run_checks(f.unionByName(gross))


CHECKS = """checks as (
  select ticker, 'gross_profit' as check_name, round(abs(revenue - cost_of_revenue - units) / greatest(abs(units), 1), 6) as diff from wide_f
  union all select ticker, 'gross_profit_from_sales', round(abs(gross_sales - cost_of_revenue - units) / greatest(abs(units), 1), 6) from wide_f
  union all select ticker, 'sales_cover_revenue', round(abs(case when revenue <= gross_sales then gross_sales else revenue end - gross_sales) / greatest(abs(gross_sales), 1), 6) from wide_f
), judged as (select ticker, check_name, case when diff <= 0.01 then 'passed' when diff <= 0.05 then 'warning' else 'failed' end as status from checks)"""
P.add("m10_run_checks", lambda s, d: _checked(s, d).filter("status <> 'skipped'").groupBy("check_name", "status").agg(F.count("*").alias("n")), "select check_name, status, count(*) as n from judged group by 1, 2", FACTS, WIDE, CHECKS)
P.add(
    "d25_confidence", lambda s, d: ratios.confidence_scores(_checked(s, d), facts(s, d).groupBy("ticker").agg(F.count_if(F.col("metric").isin("revenue", "units")).alias("mapped"), F.count("*").alias("total"))),
    """with v as (select ticker, round(count(*) filter (where status = 'passed') / count(*)::double * 100, 4) as validation from judged group by 1), e as (select ticker, round(count(*) filter (where metric in ('revenue', 'units')) / count(*)::double * 100, 4) as extraction from facts group by 1)
    select ticker, validation, extraction, least(validation, extraction) as overall from v join e using (ticker)""", FACTS, WIDE, CHECKS,
)
P.add(
    "c26_reconcile", lambda s, d: (lambda f: ratios.reconcile(f.filter("filing_type = '10-K'").unionByName(f.filter("metric = 'gross_sales' and filing_type = '10-K'").withColumn("metric", F.lit("net_income")).withColumn("statement_type", F.lit("cash_flow"))), "net_income"))(facts(s, d)),
    "select ticker, fiscal_period, net_income as income_value, gross_sales as cash_value, abs(net_income - gross_sales) > 1000000 as flagged from wide_f where filing_type = '10-K'", FACTS, WIDE,
)
P.add("m12_validate_calculated", lambda s, d: ratios.validate_calculated(facts(s, d), ["revenue", "ebitda", "fcf"]), "select ticker, 'ebitda,fcf' as missing, count(*) filter (where confidence < 0.7) as low_confidence, count(*) filter (where value < 0) as negative, false as complete from facts group by 1", FACTS)
P.add("d29_unit_scale", lambda s, d: ratios.unit_scale(facts(s, d)), "select metric, case when max(abs(value)) > 1e9 then 'billions' when max(abs(value)) > 1e6 then 'millions' when max(abs(value)) > 1e3 then 'thousands' else 'units' end as scale from facts group by 1", FACTS)

# --- peers ---------------------------------------------------------------------------


def peer_ttm_rank(s, d):
    """Flagship: TTM revenue of every member of every peer group, ranked."""
    p = ttm(peer_facts(s, d).filter("metric = 'revenue'"), ("universe", "ticker"))
    return peers.rank_peers(p.select("universe", "ticker", "value"))


RANKED = """stats as (select universe, count(*) as peers, avg(value) as mean, quantile_cont(value, 0.5) as median from vals group by 1)
select universe, ticker, value, rank() over (partition by universe order by value desc) as rank, round(mean, 2) as mean, round(median, 2) as median, round((value - median) / nullif(abs(median), 0) * 100, 6) as vs_median_pct from vals join stats using (universe)"""
P.add(
    "peer_ttm_rank", peer_ttm_rank,
    f"""with q as (select universe, ticker, value, {KEY} as key from peers where metric = 'revenue' and filing_type = '10-Q' qualify row_number() over (partition by universe, ticker order by key desc) <= 4),
    vals as (select universe, ticker, sum(value::decimal(20,2))::double as value from q group by 1, 2 having count(*) = 4), {RANKED}""", FACTS, PEERS,
)
P.add("e25_rank_peers", lambda s, d: peers.rank_peers(peer_facts(s, d).filter("metric = 'net_income' and fiscal_period = 'FY1998'").select("universe", "ticker", "value")), f"with vals as (select universe, ticker, value from peers where metric = 'net_income' and fiscal_period = 'FY1998'), {RANKED}", FACTS, PEERS)
P.add(
    "c6_expand_peers", lambda s, d: (lambda u: peers.expand_peers(u.select(F.col("member").alias("ticker")).distinct(), u))(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("universe"), F.col("n_name").alias("member"))),
    "select r_name as universe, a.n_name as ticker, b.n_name as peer from nation a join nation b using (n_regionkey) join region on r_regionkey = n_regionkey",
)
P.add(
    "e26_percentile_rank", lambda s, d: peers.percentile_rank(facts(s, d).filter("filing_type = '10-K'"), ["metric", "fiscal_period"]),
    """with p as (select metric, fiscal_period, ticker, value, round((rank() over w - 1) / (count(*) over (partition by metric, fiscal_period))::double * 100, 4) as percentile from facts where filing_type = '10-K' window w as (partition by metric, fiscal_period order by value))
    select *, percentile >= 75 or percentile <= 25 as outlier from p""", FACTS,
)
P.add(
    "d20_distribution", lambda s, d: peers.distribution(facts(s, d), ["metric", "filing_type"]),
    """with q as (select metric, filing_type, count(value) as n, avg(value) as mean, quantile_cont(value, [0.25, 0.5, 0.75]) as q from facts group by 1, 2)
    select metric, filing_type, n, round(mean, 6) as mean, round(q[1], 4) as p25, round(q[2], 4) as median, round(q[3], 4) as p75 from q""", FACTS,
)
P.add("e27_comp_table", lambda s, d: peers.comp_table(facts(s, d), ["revenue", "net_income", "ebitda"], "FY1999"), "select ticker, revenue, net_income, null::double as ebitda from wide_f where fiscal_period = 'FY1999'", FACTS, WIDE)
P.add(
    "d28_divergence", lambda s, d: peers.divergence(peer_facts(s, d), "CHINA"),
    """with m as (select metric, fiscal_period, value as sv from peers where ticker = 'CHINA'), j as (select metric, fiscal_period, ticker as peer, sv as subject_value, value, round(abs(value - sv), 2) as gap from peers join m using (metric, fiscal_period) where ticker <> 'CHINA')
    select * from j qualify row_number() over (partition by metric, fiscal_period order by gap desc, peer) = 1""", FACTS, PEERS,
)
P.add(
    "c17_fy_mismatch", lambda s, d: peers.fy_mismatch(ranked(facts(s, d).filter("filing_type = '10-Q'"), ["ticker"], F.desc("value"), "metric", "fiscal_period").select("ticker", F.col("statement_date").alias("year_end"))),
    """with y as (select ticker, dayofyear(statement_date) as d from facts where filing_type = '10-Q' qualify row_number() over (partition by ticker order by value desc, metric, fiscal_period) = 1)
    select a.ticker as a, b.ticker as b, least(abs(a.d - b.d), 365 - abs(a.d - b.d))::int as gap from y a join y b on a.ticker < b.ticker where least(abs(a.d - b.d), 365 - abs(a.d - b.d)) > 60""", FACTS,
)

# --- hierarchy -----------------------------------------------------------------------

P.add(
    "c18_with_children", lambda s, d: hierarchy.with_children(tree(s, d)),
    """with k as (select parent as id, count(*) as children, min(pos) as first_child_pos from tree where parent is not null group by 1), s as (select parent, count(*) - 1 as siblings from tree group by 1)
    select t.id, t.parent, coalesce(children, 0) as children, siblings, first_child_pos from tree t left join k using (id) left join s on s.parent is not distinct from t.parent""", TREE,
)
P.add("l1_roots", lambda s, d: hierarchy.roots(tree(s, d)), "select id, parent, value, level, pos from tree where parent is null", TREE)
P.add("l1_by_level", lambda s, d: hierarchy.by_level(tree(s, d), 1), "select id, parent, value, level, pos from tree where level = 1", TREE)
P.add("l1_display_order", lambda s, d: hierarchy.display_order(tree(s, d)), "select id, parent, row_number() over (partition by parent order by pos, id)::int as number from tree", TREE)
ROLLUP = """rolled as (
  select t.id, t.value, k.s as child_sum, k.n as children, round(t.value - k.s, 2) as variance from tree t join (select parent, sum(value::decimal(20,2))::double as s, count(*) as n from tree where parent is not null group by 1) k on k.parent = t.id
), rolled_pct as (select *, case when value = 0 then 0 else round(abs(variance) / abs(value) * 100, 6) end as variance_pct from rolled)"""
P.add("d26_rollup", lambda s, d: hierarchy.rollup(tree(s, d)), "select * from rolled_pct", TREE, ROLLUP)
P.add("f8_rollup_errors", lambda s, d: hierarchy.rollup_errors(tree(s, d).withColumn("value", F.when(F.col("level") == 1, F.round(F.col("value") * 1.5, 2)).otherwise(F.col("value"))), 1.0).filter("id like 'N%'").select("id", "children"), "select id, children from rolled_pct where id like 'N%' and value <> 0", TREE, ROLLUP)
P.add(
    "e31_key_drivers", lambda s, d: hierarchy.key_drivers(tree(s, d), 3),
    """select t.parent, t.id, t.value, round(t.value / nullif(p.value, 0) * 100, 6) as contribution_pct from tree t join tree p on p.id = t.parent qualify row_number() over (partition by t.parent order by abs(t.value) desc, t.id) <= 3""", TREE,
)
P.add("l2_paths", lambda s, d: hierarchy.paths(tree(s, d)), "with recursive walk as (select id, id as path, 0 as depth from tree where parent is null union all select t.id, w.path || '/' || t.id, w.depth + 1 from walk w join tree t on t.parent = w.id) select * from walk", TREE)
P.add("l3_subtree", lambda s, d: hierarchy.subtree(tree(s, d), "R2"), "with recursive walk as (select id, 0 as depth from tree where id = 'R2' union all select t.id, w.depth + 1 from walk w join tree t on t.parent = w.id) select * from walk", TREE)
P.add("l4_max_depth", lambda s, d: hierarchy.max_depth(tree(s, d)), "select 2 as max_depth")
P.add(
    "l7_ordered", lambda s, d: hierarchy.ordered(tree(s, d)),
    "with recursive walk as (select id, lpad(pos::varchar, 12, '0') as sort_key, 0 as indent from tree where parent is null union all select t.id, w.sort_key || '.' || lpad(t.pos::varchar, 12, '0'), w.indent + 1 from walk w join tree t on t.parent = w.id) select * from walk", TREE,
)
P.add("l8_infer_formula", lambda s, d: hierarchy.infer_formula(tree(s, d).filter("level < 2"), {"R0": "known"}), "select parent as id, case when parent = 'R0' then 'known' else string_agg(id, ' + ' order by pos, id) end as formula from tree where level < 2 and parent is not null group by 1", TREE)


def nation_edges(s, d):
    """nation k -> (3k + 1) mod 25: a graph with several cycles."""
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(k.alias("src"), ((k * 3 + 1) % 25).cast("int").alias("dst"))


P.add(
    "l5_cycles", lambda s, d: hierarchy.cycles(nation_edges(s, d)),
    """with recursive e as (select n_nationkey as src, (n_nationkey * 3 + 1) % 25 as dst from nation), w as (select src as start, dst as node, src::varchar as path, 1 as n from e where dst >= src
    union all select w.start, e.dst, w.path || '>' || w.node, w.n + 1 from w join e on e.src = w.node where w.node <> w.start and e.dst >= w.start and w.n < 24) select distinct path || '>' || node as cycle, n as length from w where node = start""",
)
P.add(
    "l6_levels", lambda s, d: hierarchy.levels(table(s, d, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("metric"), F.floor(F.col("n_nationkey") / 3).cast("int").alias("input"))),
    "with recursive w as (select 0 as node, 0 as level union all select n_nationkey, w.level + 1 from w join nation on n_nationkey > 0 and n_nationkey // 3 = w.node) select node, level from w",
)

# --- access --------------------------------------------------------------------------

ACCESS = "acc as (select distinct t.tenant_id, s.source_id from tenants t, sources s where s.visibility = 'public' or s.owner_tenant_id = t.tenant_id or exists (select 1 from grants g where g.tenant_id = t.tenant_id and g.source_id = s.source_id))"
P.add("c9_accessible", lambda s, d: access.accessible(*tenants(s, d)), "select * from acc", TENANTS, ACCESS)
P.add(
    "c10_tenant_view", lambda s, d: access.tenant_view(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey")).alias("source_id")), access.accessible(*tenants(s, d)), 2),
    "select c_custkey, case when c_custkey % 7 > 0 then c_nationkey end as source_id from customer where c_custkey % 7 = 0 or c_nationkey in (select source_id from acc where tenant_id = 2)", TENANTS, ACCESS,
)
P.add("c11_isolate", lambda s, d: access.isolate(tenants(s, d)[1], 1), "select * from sources where visibility = 'public' or owner_tenant_id = 1", TENANTS)
P.add("d31_tier_counts", lambda s, d: access.tier_counts(table(s, d, "customer").select(F.col("c_mktsegment").alias("tier"))), "select c_mktsegment as tier, count(*) as n from customer group by 1")
