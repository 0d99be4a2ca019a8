"""Every query of the analytics operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyfold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(registry.SQL[name])
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_odd_documents_against_sql(spark, tmp_path, ansi):
    """Texts with tags, without words, with other blanks, missing texts, sources and
    languages: the query reports what its SQL names, the operator all it finds."""
    from tallyfold.operators import text as op

    long = "x" * 50
    texts = ["", "  \n ", None, "<b>bold</b> " * 5, "<p>" + " word" * 300 + "</p>", f"{long} " * 199 + "<br>", f"{long} " * 450, "a\vb " * 150, "\v", "a\fb\r\nc\td " * 120, "é b c\x1fd " * 30, "😀" * 99, "😀" * 100]
    rows = [(i, t, None if i % 4 == 1 else "en", None if i % 3 == 1 else "src0") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = sorted(map(tuple, registry.QUERIES["b12_validate_chunks"](spark, str(tmp_path)).collect()))
        chunks = spark.createDataFrame([("t", 0, 0, "<i>a</i>"), (None, 1, 0, ""), ("t", 2, 0, None)], "ticker string, doc_id int, chunk_index int, content string").selectExpr("*", "if(doc_id = 2, null, 'en') as section_type")
        every = {r.doc_id: (r.errors, r.warnings) for r in op.validate_chunks(chunks).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    assert got == sorted(con.sql(registry.SQL["b12_validate_chunks"]).fetchall())
    assert {w for _, w, _ in got} == {"", "short", "long"}
    assert every == {0: ("", "short,tags"), 1: ("no ticker,no content", "short"), 2: ("no section,no content", "")}
