"""Names to canonical ones: exact, contained, fuzzy, with overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.facts import ranked
from tallyfold.operators.text import lookup_key, slug


def map_tags(rows: DataFrame, mapping: DataFrame, tag: str = "raw_label") -> DataFrame:
    """C1. Full tag (confidence 1), tag without its namespace (0.95), else a slug (0.5)."""
    m = mapping.select(F.lower("tag").alias("key"), "canonical").dropDuplicates(["key"])
    bare = lambda c: F.regexp_replace(F.lower(c), "^[a-z0-9-]+:", "")
    full = m.select(F.col("key").alias("k1"), F.col("canonical").alias("c1"))
    part = m.select(bare("key").alias("k2"), F.col("canonical").alias("c2")).dropDuplicates(["k2"])
    j = rows.withColumn("k1", F.lower(tag)).withColumn("k2", bare(F.col(tag))).join(full, "k1", "left").join(part, "k2", "left").drop("k1", "k2")
    conf = F.when(F.col("c1").isNotNull(), 1.0).when(F.col("c2").isNotNull(), 0.95).otherwise(0.5)
    return j.select(*rows.columns, F.coalesce("c1", "c2", slug(F.regexp_replace(F.col(tag), "^[A-Za-z0-9-]+:", ""))).alias("canonical"), conf.alias("map_confidence"))


def keyed_by_rarest(a: DataFrame, b: DataFrame, words_a: str, words_b: str) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` where the word of ``a`` that the fewest rows of
    ``b`` have is a word of ``b``. Whatever holds all words of a row of ``a`` is among its
    pairs, and a row has as many pairs as its rarest word has rows, however many share
    its frequent ones. ``words_a``, ``words_b``: array columns, dropped."""
    each = b.withColumn("w", F.explode(F.array_distinct(words_b))).drop(words_b)
    held = each.groupBy("w").agg(F.count("*").alias("held"))
    mine = a.withColumn("w", F.explode(F.array_distinct(words_a))).join(held, "w", "left")
    # a word that nothing has: no row can hold them all
    rarest = ranked(mine, [c for c in a.columns if c != words_a], F.coalesce("held", F.lit(0)), "w").filter("held is not null")
    return rarest.drop("held", words_a).join(each, "w").drop("w")


def map_labels(labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """C2. Exact match (1.0), else containment either way (0.9): the longest synonym,
    then the first by name. What contains a text has its rarest word, so both ways are an
    equi-join on one word a text; containment of the words in order is then checked."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    own = labels.select("label").distinct().select("label", plain("label").alias("text"), F.split(plain("label"), " ").alias("text_words"))
    syn = synonyms.select("canonical", "name").distinct().select("canonical", "name", plain("name").alias("syn"), F.split(plain("name"), " ").alias("syn_words"))
    cols = ["label", "text", "canonical", "name", "syn"]
    pairs = keyed_by_rarest(syn, own, "syn_words", "text_words").select(*cols).unionByName(keyed_by_rarest(own, syn, "text_words", "syn_words").select(*cols)).distinct()
    within = F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), "syn", F.lit(" "))) | F.concat(F.lit(" "), "syn", F.lit(" ")).contains(F.concat(F.lit(" "), "text", F.lit(" ")))
    found = pairs.filter(within).withColumn("score", F.when(F.col("text") == F.col("syn"), 1.0).otherwise(0.9))
    return ranked(found, ["label"], F.desc("score"), F.desc(F.length("syn")), "syn", "canonical").select("label", "canonical", "name", "score")


def bigram_list(col: Column) -> Column:
    t = lookup_key(col)
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))


def fuzzy_candidates(queries: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(query, name, n, m, a, b): pairs that may have a Dice of at least ``floor``, with
    their bigram numbers and bigrams.

    A text's bigrams, numbered where they repeat, are put in one order for all texts, the
    rarest first. Texts of n and m bigrams with that Dice share at least need = floor *
    (n + m) / 2 of them, so the first two shared are among the first n - need + 2 of one
    and m - need + 2 of the other: texts meet on two bigrams of their beginnings (on one,
    where need is one), and frequent bigrams, which come last, hardly ever count. Of the
    pairs that meet, those go on whose shared bigrams so far and what may follow the last
    of them reach need.
    """
    least = floor - 5e-7  # scores are rounded to six places
    whole = lambda x: F.ceil(x - 1e-9)

    def grams(df: DataFrame, col: str) -> DataFrame:
        rows = df.select(col).distinct().withColumn("g", bigram_list(F.col(col))).filter(F.size("g") > 0)
        nth = lambda x, i: F.size(F.filter(F.slice("g", F.lit(1), i + 1), lambda y: y == x)).cast("string")
        return rows.withColumn("g", F.transform("g", lambda x, i: F.concat(x, nth(x, i))))

    left, right = grams(queries, "query"), grams(names, "name")
    count = left.select(F.explode("g").alias("t")).unionByName(right.select(F.explode("g").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))

    def ordered(df: DataFrame, col: str, size: str, own: str) -> DataFrame:
        each = df.select(col, F.size("g").alias(size), F.explode("g").alias("t")).join(count, "t")
        return each.groupBy(col, size).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias(own))

    def keyed(df: DataFrame, col: str, size: str, own: str, at: str) -> DataFrame:
        """Two bigrams of the beginning (a single one for the shortest), and the later's place."""
        fewest = whole(least * (F.col(size) + whole(least * F.col(size) / (2 - least))) / 2)
        rows = df.withColumn("start", F.slice(own, F.lit(1), F.least(F.col(size), F.col(size) - fewest + 2).cast("int")))
        two = F.flatten(F.transform("start", lambda t, y: F.transform(F.slice("start", F.lit(1), y), lambda u: F.struct(y.alias(at), F.concat(u, F.lit("|"), t).alias("t")))))
        one = F.when(fewest <= 1, F.transform("start", lambda t, y: F.struct(y.alias(at), t.alias("t")))).otherwise(F.slice(F.array(F.struct(F.lit(0).alias(at), F.lit("").alias("t"))), 1, 0))
        return rows.select(col, size, F.inline(F.concat(two, one)))

    a, b = ordered(left, "query", "n", "a"), ordered(right, "name", "m", "b")
    need = whole(least * (F.col("n") + F.col("m")) / 2)
    inside = (F.col("i") <= F.col("n") - need + 1) & (F.col("j") <= F.col("m") - need + 1)
    met = keyed(a, "query", "n", "a", "i").join(keyed(b, "name", "m", "b", "j"), "t").filter(F.when(F.col("t").contains("|"), (need > 1) & inside).otherwise(need <= 1))
    # s shared bigrams are s * (s - 1) / 2 shared keys
    met = met.groupBy("query", "name", "n", "m").agg(F.count("*").alias("keys"), F.max("i").alias("i"), F.max("j").alias("j"))
    both = F.when(need > 1, (1 + F.sqrt(1 + 8 * F.col("keys"))) / 2).otherwise(F.col("keys"))
    met = met.filter(whole(both) + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1 >= need)
    return met.select("query", "name", "n", "m").join(a.select("query", "a"), "query").join(b.select("name", "b"), "name")


def fuzzy(queries: DataFrame, synonyms: DataFrame, floor: float = 0.7) -> DataFrame:
    """C3's scores: Dice over character bigrams (multisets) of every pair of at least the
    floor. ``queries``: (query); ``synonyms``: (canonical, name)."""
    pairs = fuzzy_candidates(queries, synonyms.select("name"), floor)
    score = F.round(2 * F.size(F.array_intersect("a", "b")) / (F.col("n") + F.col("m")), 6)
    scored = pairs.select("query", "name", score.alias("score")).filter(F.col("score") >= floor)
    named = scored.join(synonyms.select("name", "canonical").distinct(), "name")
    return named.groupBy("query", "canonical").agg(F.max("score").alias("score"))


def fuzzy_resolve(queries: DataFrame, synonyms: DataFrame, accept: float = 0.85, suggest: float = 0.7) -> DataFrame:
    """C3. Best match of at least ``accept``; else up to three suggestions; else none."""
    f = ranked(fuzzy(queries, synonyms, suggest), ["query"], F.desc("score"), "canonical", top=3)
    g = f.groupBy("query").agg(F.max("score").alias("best"), F.max_by("canonical", F.struct("score", F.expr("-ascii(canonical)"))).alias("first"), F.array_join(F.sort_array(F.collect_list("canonical")), "|").alias("options"))
    j = queries.select("query").distinct().join(g, "query", "left")
    sure = F.coalesce(F.col("best") >= accept, F.lit(False))
    return j.select("query", F.when(sure, "resolved").when(F.col("best").isNotNull(), "suggested").otherwise("unresolved").alias("status"), F.col("best").alias("score"), F.when(~sure, F.col("options")).alias("suggestions"))


def resolve_with_overlay(queries: DataFrame, base: DataFrame, overlay: DataFrame) -> DataFrame:
    """C5. A tenant's synonym beats the shared one."""
    key = lambda df, c: df.select(lookup_key(F.col("name")).alias("key"), F.col("canonical").alias(c)).dropDuplicates(["key"])
    j = queries.withColumn("key", lookup_key(F.col("query"))).join(key(base, "shared"), "key", "left").join(key(overlay, "own"), "key", "left")
    return j.select("query", F.coalesce("own", "shared").alias("canonical"), F.when(F.col("own").isNotNull(), "overlay").when(F.col("shared").isNotNull(), "shared").alias("origin"))


def unmapped_tags(rows: DataFrame, mapping: DataFrame, least: int = 1) -> DataFrame:
    """D10. Tags without a mapping: occurrences, tickers, first and last date, a slug."""
    known = mapping.select(F.lower("tag").alias("key")).distinct()
    out = rows.withColumn("key", F.lower("raw_label")).join(known, "key", "left_anti").groupBy("raw_label").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("filing_date").alias("first_seen"), F.max("filing_date").alias("last_seen"))
    return out.filter(F.col("n") >= least).withColumn("suggested", slug(F.regexp_replace("raw_label", "^[A-Za-z0-9-]+:", "")))


def match_concepts(queries: DataFrame, concepts: DataFrame, floor: float = 0.8) -> DataFrame:
    """C4. The concept of each query: the same key, else the best name by Dice of at least
    ``floor`` (ties by concept). ``concepts``: (concept, name)."""
    key = concepts.select(lookup_key(F.col("name")).alias("key"), "concept").groupBy("key").agg(F.min("concept").alias("exact"))
    j = queries.select("query").distinct().withColumn("key", lookup_key(F.col("query"))).join(key, "key", "left")
    near = fuzzy(j.filter("exact is null").select("query"), concepts.select(F.col("concept").alias("canonical"), "name"), floor)
    best = ranked(near, ["query"], F.desc("score"), "canonical").select("query", F.col("canonical").alias("near"), "score")
    found = j.join(best, "query", "left").select("query", F.coalesce("exact", "near").alias("concept"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))
    return found.filter("concept is not null")


def concept_bundle(concepts: DataFrame, sector: DataFrame) -> DataFrame:
    """C4. Metrics of a concept in order: its own, then its sector's, distinct."""
    both = concepts.join(sector, "concept", "left")
    metrics = F.array_distinct(F.concat("primary", F.coalesce("sector_metrics", F.array().cast("array<string>"))))
    return both.select("concept", F.posexplode(metrics).alias("position", "metric"), F.size(F.array_except("secondary", "primary")).alias("secondary_left"))


def resolve_issuers(names: DataFrame, companies: DataFrame) -> DataFrame:
    """C25. Exact lower-case name, then without its company suffix; never guessed."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,]", ""), r"\s+(inc|corp|corporation|co|company|ltd|plc|llc|sa|ag|nv|group|holdings)$", ""))
    exact = companies.select(F.lower("company").alias("k1"), F.col("ticker").alias("t1")).dropDuplicates(["k1"])
    loose = companies.groupBy(strip(F.col("company")).alias("k2")).agg(F.min("ticker").alias("t2"), F.countDistinct("ticker").alias("n")).filter("n = 1").drop("n")
    j = names.withColumn("k1", F.lower("name")).withColumn("k2", strip(F.col("name"))).join(exact, "k1", "left").join(loose, "k2", "left")
    return j.select("name", F.coalesce("t1", "t2").alias("ticker"))


def next_version(df: DataFrame) -> DataFrame:
    """E32. Newest semantic version with its patch raised by one."""
    v = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    return df.agg(F.max(v).alias("v")).select(F.concat_ws(".", F.col("v")[0], F.col("v")[1], F.col("v")[2] + 1).alias("next_version"))
