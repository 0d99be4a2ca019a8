"""The driver's tables seen as filings data: facts, chunks, peers, logs, filings, ...

Each view is a DataFrame function of (spark, directory) and, for the SQL side, a common
table expression of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ["gross_sales", "revenue", "cost_of_revenue", "operating_expenses", "income_tax_expense", "net_income", "units"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUMS = ["gross_sales", "revenue", "operating_expenses", "income_tax_expense", "units"]


def _facts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values of each supplier key, period and form. Line items are summed once, by
    quarter; years are sums of those, so the large table is shuffled once and narrow."""
    price, disc, tax, qty = (F.col(c).cast("decimal(12,2)") for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    net = price * (F.lit(1).cast("decimal(3,2)") - disc)
    day = F.to_date("l_shipdate")
    quarters = table(spark, sf_dir, "lineitem").filter("l_shipdate is not null").groupBy("l_suppkey", F.year(day).alias("y"), F.quarter(day).alias("q"))
    quarters = quarters.agg(*(F.sum(x).alias(c) for c, x in zip(SUMS, (price, net, price * disc, net * tax, qty), strict=True)))
    spans = F.array(
        F.struct(F.concat(F.lit("FY"), F.col("y")).alias("fiscal_period"), F.lit("10-K").alias("filing_type"), F.lit("annual").alias("period_type"), F.make_date("y", F.lit(12), F.lit(31)).alias("statement_date")),
        F.struct(F.concat(F.lit("Q"), F.col("q"), F.lit(" "), F.col("y")).alias("fiscal_period"), F.lit("10-Q").alias("filing_type"), F.lit("quarterly").alias("period_type"), F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("statement_date")),
    )
    keys = ["l_suppkey", "fiscal_period", "filing_type", "period_type", "statement_date"]
    sums = quarters.select("l_suppkey", *SUMS, F.explode(spans).alias("p")).select("*", "p.*").groupBy(*keys).agg(*(F.sum(c).cast("decimal(20,2)").alias(c) for c in SUMS))
    wide = sums.withColumn("cost_of_revenue", (F.col("gross_sales") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(20,2)"))
    income = F.col("revenue") - F.col("cost_of_revenue") - F.col("operating_expenses") - F.col("income_tax_expense")
    return wide.withColumn("net_income", income.cast("decimal(20,2)")).unpivot(keys, TAGS, "metric", "amount")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row per ticker, metric, fiscal period and form."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("ticker"))
    return _facts_by_key(spark, sf_dir).join(names, "l_suppkey").select(
        "ticker", "metric", F.concat(F.lit("us-gaap:"), F.col("metric")).alias("raw_label"), F.col("amount").cast("double").alias("value"), "fiscal_period", "period_type", "filing_type",
        F.lit("income_statement").alias("statement_type"), F.date_add("statement_date", 45).alias("filing_date"), "statement_date", ((65 + 5 * (F.col("l_suppkey") % 8)) / 100).alias("confidence"),
    )


FACTS = """
spans as (
  select s_suppkey, s_name as ticker, l_extendedprice::decimal(12,2) as price, l_discount::decimal(12,2) as disc, l_tax::decimal(12,2) as tax, l_quantity::decimal(12,2) as qty, l_shipdate::date as day
  from lineitem join supplier on l_suppkey = s_suppkey where l_shipdate is not null
), labelled as (
  select *, 'FY' || year(day) as fiscal_period, '10-K' as filing_type, 'annual' as period_type, make_date(year(day), 12, 31) as statement_date from spans
  union all
  select *, 'Q' || quarter(day) || ' ' || year(day), '10-Q', 'quarterly', last_day(make_date(year(day), quarter(day) * 3, 1)) from spans
), sums as (
  select s_suppkey, ticker, fiscal_period, filing_type, period_type, statement_date, sum(price)::decimal(20,2) as gross_sales, sum(price * (1.00::decimal(3,2) - disc))::decimal(20,2) as revenue,
    sum(price * disc)::decimal(20,2) as operating_expenses, sum(price * (1.00::decimal(3,2) - disc) * tax)::decimal(20,2) as income_tax_expense, sum(qty)::decimal(20,2) as units
  from labelled group by all
), money as (
  select *, (gross_sales * 0.6::decimal(2,1))::decimal(20,2) as cost_of_revenue from sums
), wide as (
  select *, (revenue - cost_of_revenue - operating_expenses - income_tax_expense)::decimal(20,2) as net_income from money
), facts as (
  select ticker, metric, 'us-gaap:' || metric as raw_label, amount::double as value, fiscal_period, period_type, filing_type, 'income_statement' as statement_type,
    (statement_date + 45)::date as filing_date, statement_date::date as statement_date, (65 + 5 * (s_suppkey % 8)) / 100.0::double as confidence
  from (unpivot wide on gross_sales, revenue, cost_of_revenue, operating_expenses, income_tax_expense, net_income, units into name metric value amount)
)
"""


def chunks(spark: SparkSession, sf_dir: str, size: int = 200) -> DataFrame:
    """V2: documents as filings, ``size`` words a chunk; the text of chunk k is words
    k * size onwards. Filing date: a day of 2020 by document id."""
    # the blanks of DuckDB's \s: Spark's has the vertical tab besides
    words = F.split(F.trim(F.regexp_replace("text", r"[\t\n\f\r ]+", " ")), " ")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(
        F.col("source").alias("ticker"), F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q").alias("filing_type"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("filing_date"),
        F.col("lang").alias("section_type"), "doc_id", words.alias("w"),
    )
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda k: F.array_join(F.slice("w", k * size + 1, size), " "))
    return rows.select("ticker", "filing_type", "filing_date", "section_type", "doc_id", F.posexplode(parts).alias("chunk_index", "content"))


CHUNKS = r"""
worded as (
  select source as ticker, case when doc_id % 2 = 0 then '10-K' else '10-Q' end as filing_type, (date '2020-01-01' + (doc_id % 700)::int)::date as filing_date, lang as section_type, doc_id,
    string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents
), numbered as (select *, unnest(range(0, (len(w) - 1) // 200 + 1))::int as chunk_index from worded),
chunks as (
  select ticker, filing_type, filing_date, section_type, doc_id, chunk_index, array_to_string(w[chunk_index * 200 + 1 : chunk_index * 200 + 200], ' ') as content from numbered
)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: events as a query log."""
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 3).alias("tenant"), "user_id", F.col("event_type").alias("method"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency"), "ts", "props",
    )


LOG = "log as (select event_id, user_id % 3 as tenant, user_id, event_type as method, event_type <> 'error' as success, value as latency, ts, props from events)"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: line items as quarterly holdings."""
    day = F.to_date("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("cusip"), F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1))).alias("report_date"), F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day)).alias("quarter"),
        F.col("l_quantity").cast("long").alias("qty"), F.col("l_extendedprice").cast("decimal(20,2)").alias("price"),
    )
    return rows.groupBy("holder", "cusip", "report_date", "quarter").agg(F.sum("qty").alias("shares"), F.sum("price").cast("double").alias("market_value"))


HOLDINGS = """
holdings as (
  select l_suppkey as holder, l_partkey as cusip, last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1))::date as report_date, 'Q' || quarter(l_shipdate) || ' ' || year(l_shipdate) as quarter,
    sum(l_quantity::bigint)::bigint as shares, sum(l_extendedprice::decimal(20,2))::double as market_value from lineitem group by 1, 2, 3, 4
)
"""


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: orders as insider transactions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("transaction_date"), F.substring("o_orderpriority", 1, 1).alias("code"), F.col("o_totalprice").alias("amount"),
    )


INSIDERS = "insiders as (select o_custkey as ticker, o_orderkey as accession, o_orderdate::date as transaction_date, substring(o_orderpriority, 1, 1) as code, o_totalprice as amount from orders)"


def tenants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V10: tenants, data sources and grants."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    t = region.select(F.col("r_regionkey").alias("tenant_id"), F.col("r_name").alias("tenant"))
    s = nation.select(F.col("n_nationkey").alias("source_id"), F.when(F.col("n_nationkey") % 3 == 0, "public").otherwise("private").alias("visibility"), F.col("n_regionkey").alias("owner_tenant_id"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda r: r))
    g = nation.select(F.col("n_nationkey").alias("source_id"), pairs.alias("tenant_id")).filter("(source_id + tenant_id) % 5 = 0")
    return t, s, g.select("tenant_id", "source_id")


TENANTS = """
tenants as (select r_regionkey as tenant_id, r_name as tenant from region),
sources as (select n_nationkey as source_id, case when n_nationkey % 3 = 0 then 'public' else 'private' end as visibility, n_regionkey as owner_tenant_id from nation),
grants as (select r_regionkey as tenant_id, n_nationkey as source_id from region, nation where (r_regionkey + n_nationkey) % 5 = 0)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11: region -> nation -> customer as a metric hierarchy."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    cents = c.select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("decimal(20,2)").alias("v"))
    by_nation = cents.groupBy("c_nationkey").agg(F.sum("v").alias("v"))
    nations = n.join(by_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_regionkey", F.coalesce("v", F.lit(0)).alias("v"))
    by_region = nations.groupBy("n_regionkey").agg(F.sum("v").alias("v"))
    rows = r.join(by_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), none.alias("parent"), F.col("v").cast("double").alias("value"), F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("pos"))
    rows = rows.unionByName(nations.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("v").cast("double").alias("value"), F.lit(1).alias("level"), F.col("n_nationkey").cast("long").alias("pos")))
    return rows.unionByName(cents.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.col("v").cast("double").alias("value"), F.lit(2).alias("level"), F.col("c_custkey").cast("long").alias("pos")))


TREE = """
by_nation as (select n_nationkey, n_regionkey, coalesce(sum(c_acctbal::decimal(20,2)), 0) as v from nation left join customer on c_nationkey = n_nationkey group by 1, 2),
tree as (
  select 'R' || r_regionkey as id, null::varchar as parent, sum(v)::double as value, 0 as level, r_regionkey::bigint as pos from region left join by_nation on n_regionkey = r_regionkey group by r_regionkey
  union all select 'N' || n_nationkey, 'R' || n_regionkey, v::double, 1, n_nationkey::bigint from by_nation
  union all select 'C' || c_custkey, 'N' || c_nationkey, c_acctbal::decimal(20,2)::double, 2, c_custkey::bigint from customer
)
"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12: orders as filings."""
    form = F.when(F.col("o_orderpriority").startswith("1"), "10-K").when(F.col("o_orderpriority").startswith("2"), "10-Q").when(F.col("o_orderpriority").startswith("3"), "10-K/A").when(F.col("o_orderpriority").startswith("4"), "8-K").otherwise("NT 10-K")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession"), form.alias("form"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderstatus").alias("status"))


FILINGS = """
filings as (
  select o_custkey as ticker, o_orderkey as accession, case substring(o_orderpriority, 1, 1) when '1' then '10-K' when '2' then '10-Q' when '3' then '10-K/A' when '4' then '8-K' else 'NT 10-K' end as form,
    o_orderdate::date as filing_date, o_orderstatus as status from orders
)
"""


def peer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: facts summed by nation; the universe is the region."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("universe"))
    nation_of = s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    keys = ["metric", "fiscal_period", "filing_type", "statement_date"]
    sums = _facts_by_key(spark, sf_dir).join(nation_of, "l_suppkey").groupBy("s_nationkey", *keys).agg(F.sum("amount").cast("double").alias("value"))
    out = sums.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select("universe", "ticker", *keys, F.date_add("statement_date", 45).alias("filing_date"), "value")


PEERS = """
peers as (
  select r_name as universe, n_name as ticker, metric, fiscal_period, filing_type, statement_date, filing_date, sum(value::decimal(20,2))::double as value
  from facts join supplier on s_name = facts.ticker join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all
)
"""
