"""Literal cases, traps and edges of the analytics operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import period
from tallyfold.operators import changes, chunking, hierarchy, peers, ratios, resolve, search, series, text
from tallyfold.sources import tables

FACT = "ticker string, metric string, fiscal_period string, filing_type string, value double, confidence double, filing_date date, statement_date date"


def facts(spark, values, metric="revenue", form="10-Q", start=2020):
    rows = []
    for k, v in enumerate(values):
        y, q = (start + k // 4, k % 4 + 1) if form == "10-Q" else (start + k, 4)
        p = f"Q{q} {y}" if form == "10-Q" else f"FY{y}"
        day = dt.date(y, 3 * q, 28)
        rows.append(("A", metric, p, form, v, 0.9, day, day))
    return spark.createDataFrame(rows, FACT)


@pytest.mark.parametrize(
    ("p", "key", "prev"),
    [("FY2024", 20240000, "FY2023"), ("2024", 20240000, "2023"), ("Q3 2024", 20240300, "Q2 2024"), ("Q1-2024", 20240100, "Q4-2023"), ("Q1FY2024", 20240100, "Q4FY2023"), ("TTM", 99990000, "TTM"), ("9M 2024", 0, "9M 2024"), ("unknown_period", 0, "unknown_period"), ("", 0, "")],
)
def test_periods(spark, p, key, prev):
    r = spark.createDataFrame([(p,)], "p string").select(period.period_key(F.col("p")), period.prev_period(F.col("p"))).first()
    assert tuple(r) == (key, prev)


def test_period_texts(spark):
    cases = {"revenue from 2019 to 2022": ("range", 2019, 2022), "in Q2 2023": ("quarter", 2023, 2023), "last 50 years": ("last_years", 30, None), "fiscal year 2021": ("year", 2021, 2021), "yoy growth": ("yoy", None, None), "most recent": ("latest", None, None), "": ("none", None, None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", period.period_from_text(F.col("t")).alias("p")).collect()
    assert {r.t: (r.p["kind"], r.p["from_year"], r.p["to_year"]) for r in df} == cases


@pytest.mark.parametrize(("t", "v"), [("$1,234.50", 1234.5), ("(12)", -12.0), ("—", 0.0), ("12.5%", 0.125), ("1.234,56", 1234.56), ("n/a", None), ("", None)])
def test_numbers(spark, t, v):
    assert spark.createDataFrame([(t,)], "t string").select(text.parse_number(F.col("t"))).first()[0] == (pytest.approx(v) if v is not None else None)


def test_literal_percentiles(spark):
    df = spark.createDataFrame([("g", f"t{v}", float(v)) for v in (1000, 2000, 3000)], "g string, ticker string, value double")
    assert [r.percentile for r in peers.percentile_rank(df, ["g"]).orderBy("value").collect()] == [0.0, 33.3333, 66.6667]
    r = peers.distribution(df.unionByName(spark.createDataFrame([("g", "x", 4000.0)], df.schema)), ["g"]).first()
    assert (r.p25, r.median, r.p75) == (1750.0, 2500.0, 3250.0)


def test_null_ranks_last_as_group_size(spark):
    df = spark.createDataFrame([("u", "a", 5.0), ("u", "b", None), ("u", "c", 5.0), ("u", "d", 1.0)], "universe string, ticker string, value double")
    assert {r.ticker: r["rank"] for r in peers.rank_peers(df).collect()} == {"a": 1, "c": 1, "d": 3, "b": 4}


def test_ttm_needs_four_quarters(spark):
    three, five = facts(spark, [1.0, 2.0, 3.0]), facts(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert series.ttm(three).count() == 0 and series.ltm(three).first().incomplete
    r = series.ttm(five).first()
    assert (r.value, r.last_quarter) == (14.0, "Q1 2021")
    assert series.ttm_chain(five).first().ttm == 14.0
    assert series.ttm_chain(five.filter("fiscal_period <> 'Q3 2020'")).first().ttm is None


def test_outlier_streak_and_reversal(spark):
    jump = facts(spark, [100e9, 102e9, 104e9, 106e9, 108e9, 200e9])
    assert [r.fiscal_period for r in series.zscore_outliers(jump).collect()] == ["Q2 2021"]
    assert series.zscore_outliers(facts(spark, [5.0] * 6)).count() == 0
    assert series.streaks(facts(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])).first().run == 5
    assert series.streaks(facts(spark, [9.0, 8.0, 3.0, 4.0, 5.0, 6.0])).count() == 0
    assert series.reversals(facts(spark, [100.0, 120.0, 90.0], form="10-K")).count() == 1
    assert series.yoy(facts(spark, [0.0, 5.0], form="10-K")).orderBy("fiscal_period").collect()[1].yoy is None


def test_formulas_are_safe(spark):
    f = facts(spark, [10.0], "a").unionByName(facts(spark, [0.0], "b"))
    got = {r.metric: (r.value, r.reason) for r in ratios.evaluate(f, {"ok": "(a + 2) * 3 / 4", "zero": "a / (b + 0)", "none": "a + c"}).collect()}
    assert got == {"ok": (9.0, None), "zero": (None, "division by zero"), "none": (None, "missing input")}
    for bad in ("a; drop table x", "a || 'x'", "`a`"):
        with pytest.raises(ValueError):
            ratios.formula_column(bad)


def test_checks_skip_and_grade(spark):
    rows = [("total_assets", 100.0), ("total_liabilities", 60.0), ("equity", 38.0)]
    df = spark.createDataFrame([("A", m, "FY2020", "10-K", v) for m, v in rows], "ticker string, metric string, fiscal_period string, filing_type string, value double")
    got = {r.check_name: r.status for r in ratios.run_checks(df).collect()}
    assert got["balance"] == "warning" and got["eps"] == "skipped" and len(got) == 16


def test_graph_levels_and_cycles(spark):
    e = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "metric string, input string")
    assert {r.node: r.level for r in hierarchy.levels(e).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    g = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    assert {r.cycle for r in hierarchy.cycles(g).collect()} == {"1>2>3>1", "5>5"}


def test_names(spark):
    q = spark.createDataFrame([("Net Revenues",), ("net revenue",), ("zzz",)], "query string")
    s = spark.createDataFrame([("revenue", "net revenue"), ("income", "net income")], "canonical string, name string")
    got = {r["query"]: r.status for r in resolve.fuzzy_resolve(q, s).collect()}
    assert got == {"Net Revenues": "resolved", "net revenue": "resolved", "zzz": "unresolved"}
    m = resolve.map_labels(spark.createDataFrame([("Total net revenue, audited",), ("nothing",)], "label string"), s).collect()
    assert [(r.canonical, r.score) for r in m] == [("revenue", 0.9)]


def test_char_windows_end(spark):
    t = "A sentence that is rather long, as such things go. " * 40
    w = chunking.char_windows(t, 300, 60)
    assert all(t[a : a + 300].strip().startswith(p[:50]) for a, p in w) and w[-1][0] + 300 >= len(t) - 1 and len(w) < 15
    assert chunking.char_windows("", 300, 60) == []


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, _order int")
    once = tables.upsert(t, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, tables.upsert(once, b, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, tables.insert_ignore(t, b.drop("_order"), ["k"]).select("k").collect())) == [(1,), (2,), (3,)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name, value\n"x, ""y""", 1 \n z ,2\n')
    assert [tuple(r) for r in tables.read_csv_table(spark, str(tmp_path / "a.csv")).collect()] == [('x, "y"', "1"), ("z", "2")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert tables.read_texts(spark, str(tmp_path / "t")).first().value == "one\ntwo"
    df = spark.createDataFrame([(1, "p"), (2, "q")], "v int, k string")
    path = str(tmp_path / "lake")
    tables.replace_partitions(df, path, "k")
    tables.replace_partitions(spark.createDataFrame([(9, "q")], df.schema), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "k").collect())) == [(1, "p"), (9, "q")]


def test_lsh_recall(spark):
    """The registered query, with its own parameters and queries, against exact search."""
    from tallyfold.plans.text import P, vectors

    sf = "/root/testdata/sf0.01"
    v = vectors(spark, sf)
    exact = {(r.query_id, r.id) for r in search.vector_top_k(v.filter("id % 100 = 0"), v, 5).collect()}
    near = {(r.query_id, r.id) for r in P.queries["k7_ann_top_k"](spark, sf).collect()}
    assert len(exact & near) >= 0.9 * len(exact) > 0


def test_vector_top_k_in_parts(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = lambda limit: sorted(map(tuple, search.vector_top_k(v.filter("id % 20 = 0"), v, 3, limit=limit).select("query_id", "rank", "id").collect()))
    assert rows(1) == rows(1000) != []


def test_vector_search_relaxes(spark):
    rows = [(1, [1.0, 0.0], "a", "x"), (2, [0.9, 0.1], "a", "y"), (3, [0.8, 0.2], "a", "x"), (4, [0.0, 1.0], "b", "x")]
    v = spark.createDataFrame(rows, "id long, v array<double>, section string, subsection string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a", "x"), (2, [0.9, 0.1], "a", "y"), (4, [0.0, 1.0], "b", "x"), (9, [1.0, 0.0], None, None)], v.schema)
    got = {(r.query_id, r["rank"]): (r.id, r.stage) for r in search.vector_search(q, v, 2).collect()}
    assert got == {(1, 1): (3, 1), (2, 1): (1, 2), (2, 2): (3, 2), (4, 1): (3, 3), (4, 2): (2, 3), (9, 1): (1, 3), (9, 2): (2, 3)}


def test_search_stages(spark):
    chunks = spark.createDataFrame([(1, 0, "net revenue grew strongly", "md", "a"), (2, 0, "revenue fell", "md", "b"), (3, 0, "risk of loss", "rf", "c")], "doc_id int, chunk_index int, content string, section_type string, subsection string")
    rows = [(1, "revenue grew strongly", ["revenue"], "md", "a", None), (2, "x", ["revenue", "net"], "md", None, None), (3, "x", ["revenue", "gain"], "md", "b", None), (4, "x", ["revenue"], "md", "zz", None), (5, "x", ["risk"], "md", None, None), (6, "x", ["nothing"], None, None, "rf"), (7, "x", ["nothing"], None, None, None)]
    q = spark.createDataFrame(rows, "query_id int, phrase string, terms array<string>, section string, subsection string, suggested string")
    got = {(r.query_id, r.doc_id): r.stage for r in search.search_chunks(q, chunks, 5).collect()}
    assert got == {(1, 1): 1, (2, 1): 2, (3, 2): 3, (4, 1): 4, (4, 2): 4, (5, 3): 5, (6, 3): 6}


def test_large_and_deep_hierarchies(spark):
    n = 1_100_000
    nodes = spark.range(1, n + 1).select("id", F.when(F.col("id") >= 10, F.floor(F.col("id") / 10)).alias("parent"), F.col("id").alias("pos"))
    assert hierarchy.paths(nodes).filter("depth = length(cast(id as string)) - 1").count() == n
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").alias("pos"))
    assert hierarchy.max_depth(chain).first()[0] == 299
    assert [r.depth for r in hierarchy.subtree(chain, 290).collect()] == list(range(10))
    lost = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 9, 1), (4, 5, 1), (5, 4, 1)], "id int, parent int, pos int")
    assert sorted(r.path for r in hierarchy.paths(lost).collect()) == ["1", "1/2"]


def test_long_cycles_and_many_levels(spark):
    ring = spark.range(25).select(F.col("id").alias("src"), ((F.col("id") + 1) % 25).alias("dst")).unionByName(spark.createDataFrame([(30, 3), (7, 40), (50, 51), (51, 50), (50, 52), (52, 50)], "src long, dst long"))
    got = {r.cycle: r.length for r in hierarchy.cycles(ring).collect()}
    assert got == {">".join(map(str, [*range(25), 0])): 25, "50>51>50": 2}
    deep = spark.range(1, 61).select(F.col("id").alias("metric"), (F.col("id") - 1).alias("input"))
    assert hierarchy.levels(deep).agg(F.max("level"), F.count("*")).first()[:] == (60, 61)


def test_versions_and_layouts(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.write_version(df, base)
    tables.write_version(df.withColumn("v", F.lit("b")), base)
    (tmp_path / "t" / "v99999999999999999999").mkdir()  # a write that failed
    assert tables.read_newest(spark, base).first().v == "b"
    rows = spark.createDataFrame([("A", "10-K", "FY2020", 1.0, True), ("B", "10-Q", "Q1 2020", 2.0, False)], "ticker string, filing_type string, fiscal_period string, value double, open boolean")
    tables.write_lake(rows, str(tmp_path / "lake"), F.when(F.col("open"), "public").otherwise("private"), "sec", "raw")
    assert (tmp_path / "lake" / "visibility=public" / "source=sec" / "stage=raw" / "ticker=A" / "filing_type=10-K" / "fiscal_period=FY2020").is_dir()
    sections = spark.createDataFrame([("A", "10-K", "Item 1/A", 7, "some text")], "ticker string, filing_type string, section_type string, doc_id int, content string")
    tables.export_sections(sections, str(tmp_path / "out"))
    about = spark.read.json(f"{tmp_path}/out/metadata").first()
    assert (about.key, about.characters, about.ticker) == ("A_10-K_Item_1_A_7", 9, "A") and "content" not in about
    assert spark.read.json(f"{tmp_path}/out/text").first().content == "some text"


def test_replace_documents(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], t.schema)
    got = tables.replace_documents(t, new, spark.createDataFrame([(1,), (2,)], "doc_id int"))
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "y"), (3, "c")]


def test_concepts_industries_and_bounds(spark):
    from tallyfold.operators import facts as fo
    from tallyfold.operators import pipelines

    concepts = spark.createDataFrame([("growth", "revenue growth"), ("margin", "gross margin")], "concept string, name string")
    q = spark.createDataFrame([("Revenue-Growth",), ("gross margins",), ("nothing alike",)], "query string")
    assert {r["query"]: r.concept for r in resolve.match_concepts(q, concepts).collect()} == {"Revenue-Growth": "growth", "gross margins": "margin"}
    rows = spark.createDataFrame([("abc", "cost_of_sales"), ("zzz", "total_assets")], "ticker string, metric string")
    m = spark.createDataFrame([("ABC", "banks")], "ticker string, industry string")
    parent = fo.parent_metric(F.col("metric"), [("^cost", "revenue")])
    got = fo.industry_of(rows, m).select("industry", parent.alias("p"), fo.indent_of(F.col("metric"), parent).alias("i")).collect()
    assert sorted(map(tuple, got)) == [("banks", "revenue", 1), ("other", None, 0)]
    with pytest.raises(ValueError):
        fo.small(spark.range(20), 10)
    many = spark.range(1001).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("a").alias("formula"), F.lit("approved").alias("status"))
    with pytest.raises(ValueError):
        pipelines.register_formulas(many, facts(spark, [1.0]))


def test_ttm_chain_of_a_quarter_told_many_times(spark):
    f = facts(spark, [1.0, 2.0, 3.0, 4.0])
    again = f.filter("fiscal_period = 'Q4 2020'").join(spark.range(20), how="cross").withColumn("filing_date", F.date_add("filing_date", F.col("id").cast("int"))).drop("id")
    r = series.ttm_chain(f.unionByName(again)).first()
    assert (r.links, r.ttm) == (4, 10.0)


def test_sections_align(spark):
    a = spark.createDataFrame([("x", "same"), ("y", "old words here"), ("z", "gone")], "section_type string, content string")
    b = spark.createDataFrame([("x", "same"), ("y", "new words here"), ("w", "fresh")], "section_type string, content string")
    assert {r.section_type: r.change for r in changes.align_sections(a, b).collect()} == {"x": "unchanged", "y": "modified", "z": "removed", "w": "added"}


def test_wide_is_one_aggregate_and_a_pivot(spark):
    """Grouping by key and metric first, as a pivot does, takes memory for every metric."""
    rows = [("A", "FY2020", "10-K", "revenue", 5.0), ("A", "FY2020", "10-K", "revenue", 7.0), ("A", "FY2020", "10-K", "other", 1.0), ("A", "Q1 2020", None, None, 2.0), ("B", "FY2020", "10-K", "units", None), ("B", "FY2021", "10-K", "units", float("nan"))]
    facts = spark.createDataFrame(rows, "ticker string, fiscal_period string, filing_type string, metric string, value double")
    got = ratios.wide(facts, ["revenue", "units", "none"])
    want = facts.groupBy(*ratios.PERIOD).pivot("metric", ["revenue", "units", "none"]).agg({"value": "max"})
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
