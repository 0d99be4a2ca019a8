"""Derived metrics: same-period combinations, ratios, formulas, accounting checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.period import prev_period
from tallyfold.operators.facts import ranked

PERIOD = ("ticker", "fiscal_period", "filing_type")


def wide(facts: DataFrame, metrics: Sequence[str], keys: Sequence[str] = PERIOD) -> DataFrame:
    """Metrics side by side. The metric list is given, so no extra pass finds it. One
    aggregate over the keys: a pivot first groups by key and metric, which takes a task as
    many times the memory as there are metrics."""
    return facts.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))


def first_of(*names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names))


def combine(facts: DataFrame, name: str, left: Sequence[str], right: Sequence[str], expr) -> DataFrame:
    """C14. ``expr(left, right)`` over the first available alias of each side in one
    period; the components stay."""
    w = wide(facts, [*dict.fromkeys([*left, *right])]).withColumn("left", first_of(*left)).withColumn("right", first_of(*right))
    return w.select(*PERIOD, F.lit(name).alias("metric"), expr(F.col("left"), F.col("right")).alias("value"), "left", "right").filter("value is not null")


def vs_previous(facts: DataFrame) -> DataFrame:
    """C15. Change against the previous period; 0 without one, which a flag tells."""
    now = facts.select(*PERIOD, "metric", "value").withColumn("prev", prev_period(F.col("fiscal_period")))
    before = facts.select("ticker", F.col("fiscal_period").alias("prev"), "filing_type", "metric", F.col("value").alias("previous"))
    j = now.join(before, ["ticker", "filing_type", "metric", "prev"], "left")
    has = F.coalesce(F.col("previous") != 0, F.lit(False))
    pct = F.when(has, F.round((F.col("value") - F.col("previous")) / F.abs("previous") * 100, 4)).otherwise(0.0)
    change = F.when(F.col("previous").isNotNull(), F.round(F.col("value") - F.col("previous"), 2)).otherwise(0.0)
    return j.select(*PERIOD, "metric", "value", "previous", change.alias("change"), pct.alias("change_pct"), F.when(pct > 1, "up").when(pct < -1, "down").otherwise("flat").alias("trend"), has.alias("has_previous"))


def hero(facts: DataFrame, drivers: Sequence[str], period: str, n: int = 6) -> DataFrame:
    """F2. Per ticker the headline metrics of a period: key drivers first, then size."""
    v = vs_previous(facts).filter(F.col("fiscal_period") == period)
    return ranked(v, ["ticker"], F.desc(F.col("metric").isin(list(drivers))), F.desc(F.abs("value")), "metric", top=n)


def market_cap(facts: DataFrame, prices: DataFrame, shares: str, cash_flow: str) -> DataFrame:
    """C28. Shares times price, and the cash-flow yield on it."""
    w = wide(facts, [shares, cash_flow]).join(prices, "ticker")
    cap = F.col(shares) * F.col("price")
    return w.select(*PERIOD, F.round(cap, 2).alias("market_cap"), F.round(F.try_divide(F.col(cash_flow), cap), 6).alias("cash_yield"))


def ratio(top: Column, bottom: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(top, bottom), digits)


def margins(facts: DataFrame) -> DataFrame:
    """M3. Gross, operating and net income with margins; gross profit as reported, else
    revenue less cost."""
    w = wide(facts, ["revenue", "gross_profit", "cost_of_revenue", "operating_expenses", "net_income"])
    gross = F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
    op = gross - F.col("operating_expenses")
    return w.select(*PERIOD, F.round(gross, 2).alias("gross_profit"), ratio(gross, F.col("revenue")).alias("gross_margin"), F.round(op, 2).alias("operating_income"), ratio(op, F.col("revenue")).alias("operating_margin"), "net_income", ratio(F.col("net_income"), F.col("revenue")).alias("net_margin"))


def ebitda(facts: DataFrame) -> DataFrame:
    """M1. Net income plus absolute tax, interest and depreciation; where net income is
    missing, operating income plus depreciation. Missing add-backs count 0."""
    names = ["net_income", "income_tax_expense", "interest_expense", "depreciation_and_amortization", "operating_income", "revenue"]
    w = wide(facts, names)
    a = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    full = F.col("net_income") + a("income_tax_expense") + a("interest_expense") + a("depreciation_and_amortization")
    value = F.coalesce(full, F.col("operating_income") + a("depreciation_and_amortization"))
    return w.select(*PERIOD, F.round(value, 2).alias("ebitda"), ratio(value, F.col("revenue")).alias("ebitda_margin")).filter("ebitda is not null")


def fcf(facts: DataFrame) -> DataFrame:
    """M2. Operating cash flow less absolute capital expenditure, and its ratios."""
    w = wide(facts, ["operating_cash_flow", "capital_expenditure", "net_income", "revenue"])
    value = F.col("operating_cash_flow") - F.abs("capital_expenditure")
    return w.select(*PERIOD, F.round(value, 2).alias("fcf"), ratio(value, F.col("net_income")).alias("cash_conversion"), ratio(F.abs("capital_expenditure"), F.col("revenue")).alias("capex_share")).filter("fcf is not null")


def working_capital(facts: DataFrame) -> DataFrame:
    """M4. Days of receivables, stock and payables, and the cash cycle."""
    w = wide(facts, ["accounts_receivable", "inventory", "accounts_payable", "revenue", "cost_of_revenue"])
    days = lambda a, b: F.try_divide(F.col(a), F.col(b)) * 365
    dso, dio, dpo = days("accounts_receivable", "revenue"), days("inventory", "cost_of_revenue"), days("accounts_payable", "cost_of_revenue")
    return w.select(*PERIOD, F.round(dso, 4).alias("dso"), F.round(dio, 4).alias("dio"), F.round(dpo, 4).alias("dpo"), F.round(dso + dio - dpo, 4).alias("cash_cycle"))


def balance_ratios(facts: DataFrame) -> DataFrame:
    """M5."""
    w = wide(facts, ["current_assets", "current_liabilities", "inventory", "total_debt", "equity", "net_income", "revenue", "total_assets"])
    c = F.col
    return w.select(
        *PERIOD, ratio(c("current_assets"), c("current_liabilities")).alias("current_ratio"), ratio(c("current_assets") - F.coalesce("inventory", F.lit(0.0)), c("current_liabilities")).alias("quick_ratio"),
        F.round(c("current_assets") - c("current_liabilities"), 2).alias("working_capital"), ratio(c("total_debt"), c("equity")).alias("debt_to_equity"), ratio(c("net_income"), c("equity")).alias("roe"), ratio(c("revenue"), c("total_assets")).alias("asset_turnover"),
    )


def fill_derived(facts: DataFrame) -> DataFrame:
    """M6. Liabilities and gross profit where they are missing but follow, flagged."""
    w = wide(facts, ["total_assets", "equity", "revenue", "cost_of_revenue"])
    rules = F.array(
        F.struct(F.lit("total_liabilities").alias("metric"), F.round(F.col("total_assets") - F.col("equity"), 2).alias("value")),
        F.struct(F.lit("gross_profit").alias("metric"), F.round(F.col("revenue") - F.col("cost_of_revenue"), 2).alias("value")),
    )
    made = w.select(*PERIOD, F.inline(rules)).filter("value is not null").join(facts.select(*PERIOD, "metric"), [*PERIOD, "metric"], "left_anti")
    made = made.select(*PERIOD, "metric", "value", F.lit(0.85).alias("confidence"), F.lit(True).alias("derived"))
    return facts.select(*PERIOD, "metric", "value", "confidence", F.lit(False).alias("derived")).unionByName(made)


def metrics_summary(facts: DataFrame) -> DataFrame:
    """M7. Nested summary per ticker over its annual periods."""
    w = wide(facts.filter("filing_type = '10-K'"), ["revenue", "gross_sales", "net_income", "operating_expenses"])
    rev = first_of("revenue", "gross_sales")
    point = F.struct("fiscal_period", rev.alias("revenue"), "net_income", ratio(F.col("net_income"), rev).alias("net_margin"))
    return w.groupBy("ticker").agg(F.sort_array(F.collect_list(point)).alias("years"), F.count("*").alias("n_years"), F.max_by(rev, "fiscal_period").alias("latest_revenue"))


# --- formulas ------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|([-+*/(),]))")
FUNCTIONS = ("abs", "round", "min", "max")


def formula_tokens(text: str) -> list[str]:
    """Tokens of a formula; anything outside the allowed ones is an error."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"formula has something else than names, numbers and + - * / ( ) at {at}: {text!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def formula_inputs(text: str) -> list[str]:
    return [t for t in dict.fromkeys(formula_tokens(text)) if (t[0].isalpha() or t[0] == "_") and t not in FUNCTIONS]


def formula_column(text: str) -> Column:
    """A formula as a column over the columns it names: only allowed tokens reach the
    SQL text; division gives null at zero (as NULLIF on the divisor does)."""
    toks = formula_tokens(text)
    sql = []
    for t in toks:
        if t in FUNCTIONS:
            sql.append({"min": "least", "max": "greatest"}.get(t, t))
        elif t[0].isalpha() or t[0] == "_":
            sql.append(f"`{t}`")
        else:
            sql.append(t)
    return F.expr(" ".join(_guard(sql)))


def _guard(toks: list[str]) -> list[str]:
    """Wraps what follows each / in nullif(..., 0): a name, number, call or parenthesis."""
    out, k = [], 0
    while k < len(toks):
        out.append(toks[k])
        if toks[k] == "/":
            start = k + 1
            end = start
            if toks[end] in ("abs", "round", "least", "greatest"):
                end += 1
            if toks[end] == "(":
                depth = 0
                while True:
                    depth += {"(": 1, ")": -1}.get(toks[end], 0)
                    if depth == 0:
                        break
                    end += 1
            out += ["nullif(", *_guard(toks[start : end + 1]), ", 0)"]
            k = end
        k += 1
    return out


def evaluate(facts: DataFrame, formulas: dict[str, str], digits: int = 6) -> DataFrame:
    """M8. Each formula over each period: value, or null and the reason, and its text."""
    inputs = [*dict.fromkeys(i for f in formulas.values() for i in formula_inputs(f))]
    w = wide(facts, inputs)
    made = []
    for name, text in formulas.items():
        lacks = F.greatest(*(F.col(i).isNull() for i in formula_inputs(text)), F.lit(False), F.lit(False))
        value = F.round(formula_column(text), digits)
        reason = F.when(lacks, "missing input").when(value.isNull(), "division by zero")
        made.append(F.struct(F.lit(name).alias("metric"), F.when(~lacks, value).alias("value"), reason.alias("reason"), F.lit(text).alias("formula")))
    return w.select(*PERIOD, F.inline(F.array(*made)))


def resolve_computed(facts: DataFrame, formulas: dict[str, str], levels: Sequence[Sequence[str]]) -> DataFrame:
    """M9. Formulas that name other formulas, wave by wave; the loop is over levels."""
    inputs = [i for f in formulas.values() for i in formula_inputs(f) if i not in formulas]
    w = wide(facts, [*dict.fromkeys(inputs)])
    names = []
    for level in levels:
        w = w.withColumns({n: formula_column(formulas[n]) for n in level})
        names += level
    return w.select(*PERIOD, *(F.round(n, 6).alias(n) for n in names))


# --- checks --------------------------------------------------------------------------


def check(name: str, got: Column, expected: Column, passed: float = 0.01, warned: float = 0.05) -> Column:
    """M10. One accounting check: skipped on missing input, else by relative difference."""
    diff = F.round(F.abs(got - expected) / F.nullif(F.greatest(F.abs(expected), F.lit(1.0)), F.lit(0.0)), 6)
    status = F.when(got.isNull() | expected.isNull(), "skipped").when(diff <= passed, "passed").when(diff <= warned, "warning").otherwise("failed")
    return F.struct(F.lit(name).alias("check_name"), status.alias("status"), diff.alias("diff"))


def run_checks(facts: DataFrame) -> DataFrame:
    """M10. All checks of each period, one row per check."""
    names = (
        "total_assets current_assets noncurrent_assets total_liabilities current_liabilities noncurrent_liabilities equity gross_profit revenue cost_of_revenue operating_income operating_expenses net_income "
        "income_before_tax income_tax_expense eps shares cash_begin cash_end operating_cash_flow investing_cash_flow financing_cash_flow net_change_in_cash cash net_income_cash_flow gross_sales"
    ).split()
    w, c = wide(facts, names), F.col
    less = lambda a, b: F.when(c(a) <= c(b), c(b)).otherwise(c(a))
    checks = [
        check("assets_sum", c("current_assets") + c("noncurrent_assets"), c("total_assets")),
        check("liabilities_sum", c("current_liabilities") + c("noncurrent_liabilities"), c("total_liabilities")),
        check("liabilities_by_equity", c("total_assets") - c("equity"), c("total_liabilities")),
        check("balance", c("total_liabilities") + c("equity"), c("total_assets")),
        check("equity_difference", c("total_assets") - c("total_liabilities"), c("equity")),
        check("component_within_total", less("current_assets", "total_assets"), c("total_assets")),
        check("gross_profit", c("revenue") - c("cost_of_revenue"), c("gross_profit")),
        check("gross_profit_from_sales", c("gross_sales") - c("cost_of_revenue"), c("gross_profit")),
        check("operating_income", c("gross_profit") - c("operating_expenses"), c("operating_income")),
        check("net_income", c("income_before_tax") - c("income_tax_expense"), c("net_income")),
        check("eps", c("net_income") / F.nullif(c("shares"), F.lit(0.0)), c("eps"), 0.05, 0.05),
        check("cash_change", c("operating_cash_flow") + c("investing_cash_flow") + c("financing_cash_flow"), c("net_change_in_cash")),
        check("cash_roll", c("cash_begin") + c("net_change_in_cash"), c("cash_end")),
        check("cash_on_balance_sheet", c("cash_end"), c("cash")),
        check("net_income_across_statements", c("net_income"), c("net_income_cash_flow")),
        check("sales_cover_revenue", less("revenue", "gross_sales"), c("gross_sales")),
    ]
    return w.select(*PERIOD, F.inline(F.array(*checks)))


def confidence_scores(checks: DataFrame, stats: DataFrame) -> DataFrame:
    """D25. Validation (passed share of checks that ran), extraction (mapped share of
    tags) and the lower of both; nothing to judge counts 100."""
    ran = F.count_if(F.col("status") != "skipped")
    v = checks.groupBy("ticker").agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("status") == "passed"), ran) * 100, 4), F.lit(100.0)).alias("validation"))
    s = stats.select("ticker", F.coalesce(F.round(F.try_divide(F.col("mapped"), F.col("total")) * 100, 4), F.lit(100.0)).alias("extraction"))
    return v.join(s, "ticker", "full").select("ticker", F.coalesce("validation", F.lit(100.0)).alias("validation"), F.coalesce("extraction", F.lit(100.0)).alias("extraction"), F.least(F.coalesce("validation", F.lit(100.0)), F.coalesce("extraction", F.lit(100.0))).alias("overall"))


def reconcile(facts: DataFrame, metric: str, tolerance: float = 1e6) -> DataFrame:
    """C26. One metric on two statements of a period, where the values part."""
    own = facts.filter(F.col("metric") == metric)
    side = lambda s, n: own.filter(F.col("statement_type") == s).select("ticker", "fiscal_period", F.col("value").alias(n))
    j = side("income_statement", "income_value").join(side("cash_flow", "cash_value"), ["ticker", "fiscal_period"])
    return j.withColumn("flagged", F.abs(F.col("income_value") - F.col("cash_value")) > tolerance)


def validate_calculated(metrics: DataFrame, required: Sequence[str]) -> DataFrame:
    """M12. Per ticker: required metrics it lacks, low-confidence and negative counts."""
    got = metrics.groupBy("ticker").agg(F.collect_set("metric").alias("have"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence"), F.count_if(F.col("value") < 0).alias("negative"))
    lacks = F.array_except(F.array(*(F.lit(r) for r in required)), "have")
    return got.select("ticker", F.array_join(F.sort_array(lacks), ",").alias("missing"), "low_confidence", "negative", (F.size(lacks) == 0).alias("complete"))


def apply_sign(value: Column, convention: Column) -> Column:
    """H16."""
    return F.when(convention == "absolute", F.abs(value)).when((convention == "negative") & (value > 0), -value).when((convention == "positive") & (value < 0), -value).otherwise(value)


def computable(facts: DataFrame, needs: dict[str, Sequence[str]]) -> DataFrame:
    """D32. Which derived metrics each ticker's inputs allow."""
    have = facts.groupBy("ticker").agg(F.collect_set("metric").alias("have"))
    rules = F.array(*(F.when(F.size(F.array_except(F.array(*(F.lit(i) for i in inputs)), "have")) == 0, F.lit(name)) for name, inputs in needs.items()))
    return have.select("ticker", F.explode(F.array_compact(rules)).alias("metric"))


def unit_scale(facts: DataFrame) -> DataFrame:
    """D29."""
    m = F.max(F.abs("value"))
    return facts.groupBy("metric").agg(F.when(m > 1e9, "billions").when(m > 1e6, "millions").when(m > 1e3, "thousands").otherwise("units").alias("scale"))
