"""Fiscal periods as strings: sort keys, equality, predecessors, labels from dates.

Grammar: ``FY2024``, ``2024``, ``Q3 2024``, ``Q3-2024``, ``Q3FY2024``, ``9M 2024``, ``TTM``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = r"^Q([1-4])[ -]?(?:FY)?((?:19|20)\d{2})$"
ANNUAL = r"^(?:FY ?)?((?:19|20)\d{2})$"
MONTHS = r"^(\d{1,2})M[ -]?(?:FY)?((?:19|20)\d{2})$"


def _group(col: Column, pattern: str, n: int) -> Column:
    got = F.regexp_extract(col, pattern, n)
    return F.when(got != "", got.cast("int"))


def _clean(col: Column) -> Column:
    return F.upper(F.trim(col))


def period_key(col: Column) -> Column:
    """Integer that sorts periods: year * 10000, plus quarter * 100; TTM last; 0 for
    anything else."""
    p = _clean(col)
    quarter = _group(p, QUARTER, 2) * 10000 + _group(p, QUARTER, 1) * 100
    return F.coalesce(quarter, _group(p, ANNUAL, 1) * 10000, F.when(p.isin("TTM", "LTM"), 99_990_000), F.lit(0)).cast("int")


def chart_key(col: Column) -> Column:
    """As ``period_key``, and also two-digit years (``FY24``, ``Q1 24``) and ``1Q25``."""
    p = _clean(col)
    short = r"^(?:Q([1-4])[ -]?|([1-4])Q[ -]?|FY ?)'?(\d{2})$"
    q = F.coalesce(_group(p, short, 1), _group(p, short, 2), F.lit(0))
    late = r"^([1-4])Q[ -]?((?:19|20)\d{2})$"
    own = period_key(col)
    return F.when(own > 0, own).otherwise(F.coalesce(_group(p, late, 2) * 10000 + _group(p, late, 1) * 100, (_group(p, short, 3) + 2000) * 10000 + q * 100, F.lit(0))).cast("int")


def same_period(a: Column, b: Column) -> Column:
    """Equal once FY, dashes and blanks are gone."""
    norm = lambda c: F.regexp_replace(_clean(c), r"FY|[\s-]", "")
    return (norm(a) == norm(b)) | ((period_key(a) > 0) & (period_key(a) == period_key(b)))


def prev_period(col: Column) -> Column:
    """FY and bare years go back a year, quarters one quarter; others stay."""
    p = F.trim(col)
    y, q = _group(p, r"^Q([1-4])([ -]?(?:FY)?)(\d{4})$", 3), _group(p, r"^Q([1-4])([ -]?(?:FY)?)(\d{4})$", 1)
    gap = F.regexp_extract(p, r"^Q([1-4])([ -]?(?:FY)?)(\d{4})$", 2)
    quarter = F.when(q == 1, F.concat(F.lit("Q4"), gap, y - 1)).otherwise(F.concat(F.lit("Q"), q - 1, gap, y))
    year = F.regexp_extract(p, r"^(FY ?)?(\d{4})$", 2)
    return F.when(q.isNotNull(), quarter).when(year != "", F.concat(F.regexp_extract(p, r"^(FY ?)?(\d{4})$", 1), year.cast("int") - 1)).otherwise(col)


def period_from_span(start: Column, end: Column, instant: Column) -> Column:
    """Label of a reporting span by its length in days; an instant is its year."""
    days = F.datediff(end, start)
    fy = F.concat(F.lit("FY"), F.year(end))
    return (
        F.when(instant.isNotNull(), F.concat(F.lit("FY"), F.year(instant)))
        .when(days.between(330, 380), fy)
        .when(days.between(80, 100), F.concat(F.lit("Q"), F.quarter(end), F.lit(" "), F.year(end)))
        .when(days.between(260, 290), F.concat(F.lit("9M "), F.year(end)))
        .when(days.between(170, 200), F.concat(F.lit("6M "), F.year(end)))
        .otherwise(fy)
    )


def period_from_filing(form: Column, date: Column) -> Column:
    """Label by form: annual forms FY, 10-Q the quarter of the date, else year-month."""
    return F.when(form.isin("10-K", "40-F", "20-F"), F.concat(F.lit("FY"), F.year(date))).when(form == "10-Q", F.concat(F.lit("Q"), F.quarter(date), F.lit("-"), F.year(date))).otherwise(F.date_format(date, "yyyy-MM"))


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date), F.lit(" "), F.year(date))


def valid_period(col: Column) -> Column:
    """A plausible period: known grammar, year within 1990 and 2030."""
    p = _clean(col)
    year = F.coalesce(_group(p, QUARTER, 2), _group(p, ANNUAL, 1), _group(p, MONTHS, 2))
    return F.coalesce(year.between(1990, 2030), F.lit(False))


def period_range(start: Column, end: Column) -> Column:
    """All annual labels from one to the other; null if not parseable or reversed."""
    a, b = _group(_clean(start), ANNUAL, 1), _group(_clean(end), ANNUAL, 1)
    return F.when(a <= b, F.transform(F.sequence(a, b), lambda y: F.concat(F.lit("FY"), y.cast("string"))))


def period_from_text(col: Column) -> Column:
    """Struct (kind, from_year, to_year, quarter) of the first period a text names, most
    specific first: range, quarter, fiscal year, last N years (30 at most), decade,
    year-over-year, latest."""
    t = F.lower(col)
    num = lambda p, n=1: _group(t, p, n)
    span, quarter, fiscal, last, decade = r"((?:19|20)\d{2})\s*(?:-|to|through|and)\s*((?:19|20)\d{2})", r"q([1-4])[-\s]*(?:fy)?\s*((?:19|20)\d{2})", r"(?:fy|fiscal year|fiscal)?\s*((?:19|20)\d{2})", r"(?:last|past|previous)\s+(\d{1,3})\s+years?", r"\b(?:last|past)\s+decade\b"
    null = F.lit(None).cast("int")

    def out(kind: str, a: Column = null, b: Column = null, q: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("from_year"), b.alias("to_year"), q.alias("quarter"))

    return (
        F.when(num(span).isNotNull(), out("range", num(span, 1), num(span, 2)))
        .when(num(quarter).isNotNull(), out("quarter", num(quarter, 2), num(quarter, 2), num(quarter, 1)))
        .when(num(last).isNotNull(), out("last_years", F.least(num(last), F.lit(30))))
        .when(t.rlike(decade), out("last_years", F.lit(10)))
        .when(num(fiscal).isNotNull(), out("year", num(fiscal), num(fiscal)))
        .when(t.rlike(r"year[- ]over[- ]year|\byoy\b"), out("yoy"))
        .when(t.rlike(r"\b(latest|most recent|current)\b"), out("latest"))
        .otherwise(out("none"))
    )
