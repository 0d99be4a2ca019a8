"""Statement pivots: templates, aliases, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked, small


def statement(facts: DataFrame, template: DataFrame, periods: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """N1, C30. Template rows in order for every ticker, a value column per period;
    headers keep their place without values. ``template``: (position, name, metric,
    is_header, indent); periods are a given list, so one pivot pass does it. The grid has a row per ticker
    and template row; a template has at most 10,000 rows."""
    best = ranked(facts.filter(F.col("fiscal_period").isin(list(periods))), [*keys, "metric", "fiscal_period"], F.desc("filing_date"), F.desc("value"))
    values = best.groupBy(*keys, "metric").pivot("fiscal_period", list(periods)).agg(F.first("value"))
    grid = facts.select(*keys).distinct().withColumn("one", F.lit(1)).join(small(template.withColumn("one", F.lit(1))), "one").drop("one")
    return grid.join(values, [*keys, "metric"], "left").select(*keys, "position", "name", "is_header", "indent", *(F.col(f"`{p}`") for p in periods))


def statement_industry(facts: DataFrame, template: DataFrame, aliases: DataFrame, periods: Sequence[str]) -> DataFrame:
    """N2. As N1, a cell falling back to the first alias that has a value.

    ``aliases``: (position, metric, priority)."""
    hit = facts.filter(F.col("fiscal_period").isin(list(periods))).join(aliases, "metric")
    cell = ranked(hit, ["ticker", "position", "fiscal_period"], "priority", F.desc("filing_date"), F.desc("value"))
    values = cell.groupBy("ticker", "position").pivot("fiscal_period", list(periods)).agg(F.first("value"))
    grid = facts.select("ticker").distinct().withColumn("one", F.lit(1)).join(small(template.withColumn("one", F.lit(1))), "one").drop("one")
    return grid.join(values, ["ticker", "position"], "left").select("ticker", "position", "name", *(F.col(f"`{p}`") for p in periods))


def melt_statement(grid: DataFrame, label: str, periods: Sequence[str]) -> DataFrame:
    """A17. Wide statement to tall facts: one row per numeric cell; projected periods,
    total rows and indent by the label are told."""
    tall = grid.withColumn("_label", F.col(label)).unpivot([label, "_label"], list(periods), "fiscal_period", "cell")
    v = F.regexp_replace("cell", r"[,$\s]", "").try_cast("double")
    text = F.trim("_label")
    return tall.select(
        text.alias("label"), "fiscal_period", v.alias("value"), F.col("fiscal_period").rlike(r"(?i)(E$|est|proj|forecast)").alias("projected"), F.lower(text).rlike(r"^total\b").alias("is_total"),
        F.floor((F.length("_label") - F.length(F.ltrim("_label"))) / 2).cast("int").alias("indent"),
    ).filter("value is not null")


def first_numeric(grid: DataFrame, label: str, cells: Sequence[str]) -> DataFrame:
    """A18. First numeric cell of each labelled row."""
    v = F.coalesce(*(F.regexp_replace(c, r"[,$%\s]", "").try_cast("double") for c in cells))
    return grid.filter(F.trim(label) != "").select(F.trim(label).alias("label"), v.alias("value")).filter("value is not null")
