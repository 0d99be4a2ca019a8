"""Text functions and chunk analytics, on built-in columns throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked


def lookup_key(col: Column) -> Column:
    """H11. Lower case, everything but letters and digits gone."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def slug(col: Column) -> Column:
    """H11. Storage slug: lower case, runs of other characters to one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snake(col: Column) -> Column:
    """H11. CamelCase to snake_case."""
    return F.lower(F.regexp_replace(col, "(?<!^)(?=[A-Z])", "_"))


def clean_text(col: Column) -> Column:
    """H24, A21. Tags, links, ISO dates, control characters and long numbers go; white
    space becomes one blank."""
    for pattern in (r"(?is)<(script|style)\b.*?</\1>", r"<[^>]+>", r"https?://\S+", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{10,}\b", r"[\x00-\x1F\x7F]"):
        col = F.regexp_replace(col, pattern, " ")
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def words_over(col: Column, n: int = 2) -> Column:
    """Distinct lower-case words longer than ``n``."""
    return F.array_distinct(F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > n))


def jaccard(a: Column, b: Column) -> Column:
    """H12. Word-set similarity; two empty sets are equal."""
    x, y = words_over(a), words_over(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine(a: Column, b: Column) -> Column:
    """H13. Cosine of two vectors; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def keywords(col: Column, stop: Sequence[str], n: int = 5) -> Column:
    """H9. First ``n`` words of more than two letters that are no stop words."""
    w = F.split(F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}\s]", " ")), r"\s+")
    return F.slice(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(list(stop))), 1, n)


def query_pattern(col: Column, tickers: Sequence[str] = ()) -> Column:
    """H10. Known tickers, periods and numbers as placeholders."""
    if tickers:
        col = F.regexp_replace(col, rf"\b({'|'.join(tickers)})\b", "[TICKER]")
    col = F.regexp_replace(col, r"(?i)\b(q[1-4]\s*(fy)?\s*(19|20)\d{2}|fy\s*(19|20)?\d{2}|(19|20)\d{2})\b", "[PERIOD]")
    return F.lower(F.regexp_replace(col, r"\b\d+(\.\d+)?\b", "[NUMBER]"))


def parse_number(col: Column, scale: Column | int = 0, percent: bool = True) -> Column:
    """H15. Numbers as printed: parentheses negate, currency and blanks go, a dash is 0,
    a percentage is divided by 100, ``1.234,56`` is read the European way."""
    t = F.trim(F.regexp_replace(col, r"[$€£¥\s]", ""))
    neg = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, r"[()]", "")
    pct = t.endswith("%")
    t = F.regexp_replace(t, "%$", "")
    euro = t.rlike(r"^-?\d{1,3}(\.\d{3})*,\d{1,2}$")
    plain = F.when(euro, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(t, ",", ""))
    v = F.when(t.isin("-", "–", "—"), 0.0).otherwise(plain.try_cast("double"))
    v = F.when(neg, -v).otherwise(v)
    return (F.when(pct & F.lit(percent), v / 100).otherwise(v)) * F.pow(F.lit(10.0), F.lit(scale) if isinstance(scale, int) else scale)


def reporting_unit(text: Column) -> Column:
    """H17."""
    t = F.lower(text)
    return F.when(t.rlike(r"in billions"), "billions").when(t.rlike(r"in millions"), "millions").when(t.rlike(r"in thousands"), "thousands").otherwise("units")


def statement_type(col: Column) -> Column:
    """H18. By key words of the tag, first that fits."""
    t = F.lower(col)
    return F.when(t.rlike("cash_?flow|financing|investing|capex"), "cash_flow").when(t.rlike("asset|liabilit|equity|receivable|payable|inventory"), "balance_sheet").when(t.rlike("revenue|income|expense|sales|cost|profit|earnings|tax"), "income_statement").otherwise("other")


def format_value(v: Column) -> Column:
    """H19. $1.2B, $3.4M, $5.6K, or two decimals."""
    a = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    num = lambda d, suffix: F.concat(sign, F.lit("$"), F.format_number(a / d, 1), F.lit(suffix))
    return F.when(a >= 1e9, num(1e9, "B")).when(a >= 1e6, num(1e6, "M")).when(a >= 1e3, num(1e3, "K")).otherwise(F.concat(sign, F.lit("$"), F.format_number(a, 2)))


def metric_label(col: Column) -> Column:
    """H19. snake_case to words with capitals."""
    return F.initcap(F.regexp_replace(col, "_", " "))


def metric_format(col: Column) -> Column:
    """H20."""
    t = F.lower(col)
    return F.when(t.rlike("eps|per_share"), "eps").when(t.rlike("margin|rate|growth|ratio|yield|pct|percent"), "percentage").when(t.rlike("units|shares|count|number|employees"), "number").otherwise("currency")


def band_label(v: Column, bands: Sequence[tuple[float | None, float | None, str]]) -> Column:
    """H21. The first band [low, high) that holds the value."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        if high is not None:
            inside = inside & (v < high)
        out = F.when(inside & v.isNotNull(), label).otherwise(out)
    return out


def token_estimate(col: Column) -> Column:
    """H23."""
    return F.ceil(F.length(col) / 4)


def text_quality(col: Column) -> Column:
    """H25. 1 less 0.2 per issue: special characters, single letters, short, no blanks."""
    n = F.nullif(F.length(col), F.lit(0))
    words = F.size(F.split(F.trim(col), r"\s+"))
    issues = [F.regexp_count(col, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / n > 0.1, F.regexp_count(col, F.lit(r"(?<=^|\s)\p{L}(?=\s|$)")) / words > 0.3, F.length(col) < 100, ~col.rlike(r"\s")]
    return F.round(1 - 0.2 * sum((F.coalesce(i, F.lit(True)).cast("int") for i in issues), F.lit(0)), 2)


def grounded(value: Column, text: Column) -> Column:
    """H26. Whether a printed form of the number occurs in the text, and how surely."""
    whole = F.instr(text, F.format_number(value, 0)) > 0
    forms = F.array(F.format_number(value / 1e6, 1), F.format_number(value / 1e3, 0), F.format_number(value / 1e9, 1))
    return F.when(whole, 1.0).when(F.exists(forms, lambda f: F.instr(text, f) > 0), 0.7).otherwise(0.0)


def section_title(col: Column) -> Column:
    """H29."""
    return F.initcap(F.regexp_replace(col, "[_-]+", " "))


def excerpt(content: Column, query: str, n: int = 60) -> Column:
    """H31. Text around the first match, or the start."""
    at = F.instr(F.lower(content), query.lower())
    return F.when(at > 0, F.substring(content, F.greatest(at - n, F.lit(1)), F.lit(2 * n + len(query)))).otherwise(F.substring(content, 1, 2 * n))


def relevance(content: Column, phrase: str, terms: Sequence[str], position: Column) -> Column:
    """H22."""
    t = F.lower(content)
    share = sum((t.contains(k.lower()).cast("int") for k in terms), F.lit(0)) / max(len(terms), 1)
    raw = 0.3 + F.when(t.contains(phrase.lower()), 0.4).otherwise(0.0) + 0.2 * share - 0.02 * position + F.when(F.length(content) > 1000, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.95), raw)), 6)


def occurrences(col: Column, terms: Sequence[str]) -> Column:
    """Whole-word occurrences of any of the terms."""
    return F.regexp_count(F.lower(col), F.lit(rf"\b({'|'.join(terms)})\b"))


# --- chunk analytics -----------------------------------------------------------------


def sentiment(chunks: DataFrame, positive: Sequence[str], negative: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """I1. (pos - neg) / (pos + neg) over a group's chunks and its label."""
    g = chunks.groupBy(*keys).agg(F.sum(occurrences(F.col("content"), positive)).alias("pos"), F.sum(occurrences(F.col("content"), negative)).alias("neg"))
    s = F.round((F.col("pos") - F.col("neg")) / F.greatest(F.col("pos") + F.col("neg"), F.lit(1)), 6)
    return g.withColumn("score", s).withColumn("label", band_label(F.col("score"), [(0.5, None, "very positive"), (0.1, 0.5, "positive"), (-0.1, 0.1, "neutral"), (-0.5, -0.1, "negative"), (None, -0.5, "very negative")]))


def sentiment_delta(scored: DataFrame, keys: Sequence[str], date: str = "filing_date") -> DataFrame:
    """I2. Change of the score against the filing before, over the newest four."""
    w = W.partitionBy(*keys).orderBy(date)
    last = ranked(scored, keys, F.desc(date), top=4).withColumn("delta", F.round(F.col("score") - F.lag("score").over(w), 6))
    return last.filter("delta is not null").withColumn("material", F.abs("delta") > 0.3).withColumn("direction", F.when(F.col("delta") > 0.1, "up").when(F.col("delta") < -0.1, "down").otherwise("flat"))


def qualifiers(col: Column, strong: Sequence[str], weak: Sequence[str], hedge: Sequence[str]) -> Column:
    """I3. 5 + 2 strong - 1.5 weak - 2 hedging words, rounded, within 0 and 10."""
    n = lambda ws: sum((F.lower(col).contains(w).cast("int") for w in ws), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(10), F.floor(5 + 2 * n(strong) - 1.5 * n(weak) - 2 * n(hedge) + 0.5).cast("int")))


def defensive(col: Column, patterns: Sequence[str]) -> Column:
    """I4. Two per pattern, ten at most."""
    return F.least(F.lit(10), sum((F.lower(col).rlike(p).cast("int") for p in patterns), F.lit(0)) * 2)


def forward_looking(chunks: DataFrame, groups: dict[str, str]) -> DataFrame:
    """I6. Sentences of more than 20 characters by the first pattern group they match."""
    s = chunks.select("ticker", "doc_id", "chunk_index", F.posexplode(F.split("content", r"[.!?]+")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") > 20)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(groups.items()):
        kind = F.when(F.lower("sentence").rlike(pattern), name).otherwise(kind)
    return s.withColumn("strength", kind).filter("strength is not null")


def credibility(statements: DataFrame, walkbacks: DataFrame) -> DataFrame:
    """I7. Share of strong statements that were not walked back, in per cent; 50 with
    none."""
    s = statements.groupBy("ticker").agg(F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak"))
    j = s.join(walkbacks.groupBy("ticker").agg(F.count("*").alias("walked")), "ticker", "left").withColumn("walked", F.coalesce("walked", F.lit(0)))
    raw = F.when(F.col("strong") == 0, 50.0).otherwise((F.col("strong") - F.col("walked")) / F.col("strong") * 100)
    return j.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 4))


def risks(chunks: DataFrame, words: Sequence[str], severe: Sequence[str]) -> DataFrame:
    """I10. Risk sentences merged by the first 50 characters of their title."""
    s = chunks.select("ticker", F.explode(F.split("content", r"[.!?]+")).alias("s")).withColumn("s", F.trim("s")).filter(F.length("s") > 20)
    s = s.filter(F.lower("s").rlike(rf"\b({'|'.join(words)})\b"))
    title = F.substring(F.lower(F.array_join(F.slice(F.split("s", r"\s+"), 1, 8), " ")), 1, 50)
    level = F.when(F.lower("s").rlike(rf"\b({'|'.join(severe)})\b"), 2).otherwise(1)
    return s.groupBy("ticker", title.alias("title")).agg(F.count("*").alias("mentions"), F.max(level).alias("severity"))


def tone_shift(chunks: DataFrame, words: Sequence[str], least: int = 3) -> DataFrame:
    """E24. Word counts of the two newest filing dates of a ticker, where one moved."""
    d = chunks.withColumn("k", F.dense_rank().over(W.partitionBy("ticker").orderBy(F.desc("filing_date")))).filter("k <= 2")
    g = d.groupBy("ticker").agg(*(F.sum(F.when(F.col("k") == k, F.regexp_count(F.lower("content"), F.lit(rf"\b{w}\b"))).otherwise(0)).alias(f"{w}_{k}") for w in words for k in (1, 2)))
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"{w}_1").alias("now"), F.col(f"{w}_2").alias("before")) for w in words))
    return g.select("ticker", F.inline(rows)).withColumn("change", F.col("now") - F.col("before")).filter(F.abs("change") >= least)


def validate_chunks(chunks: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """B12. Error and warning lists of each chunk; ``only`` names the ones to report where
    not all are asked for."""
    bad = lambda cond, text: F.when(cond & F.lit(only is None or text in only), F.lit(text))
    n = F.length("content")
    errors = F.array_compact(F.array(bad(F.col("ticker").isNull(), "no ticker"), bad(F.col("section_type").isNull(), "no section"), bad(F.col("content").isNull() | (F.trim("content") == ""), "no content"), bad(F.col("chunk_index").isNull(), "no index")))
    warnings = F.array_compact(F.array(bad(n < 100, "short"), bad(n > 8000, "long"), bad(F.col("content").rlike("<[a-zA-Z/][^>]*>"), "tags")))
    return chunks.select("doc_id", "chunk_index", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


def tickers_in(df: DataFrame, col: str, known: DataFrame) -> DataFrame:
    """H8. Known tickers that occur as words, per row id."""
    w = df.select("id", F.explode(F.array_distinct(F.split(F.lower(col), r"[^a-z0-9.]+"))).alias("key")).filter("key <> ''")
    return w.join(known.select(F.lower("ticker").alias("key"), "ticker"), "key").select("id", "ticker")
