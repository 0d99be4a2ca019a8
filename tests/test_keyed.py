"""Keyed tables: only the buckets of a batch change, and only when the log says so."""

from pathlib import Path

import pytest

from tallyfold.sources.keyed import KeyedTable

ROWS = "doc_id int, chunk_index int, content string"


def made(spark, path, n=60, buckets=16):
    rows = [(k // 3, k % 3, f"text {k}") for k in range(n)]
    df = spark.createDataFrame(rows, ROWS)
    table = KeyedTable.create(spark, str(path), df.schema, ["doc_id"], buckets)
    table.upsert(df, ["doc_id", "chunk_index"])
    return table, {r[:2]: r[2] for r in rows}


def content(table):
    rows = table.read().collect()
    out = {(r.doc_id, r.chunk_index): r.content for r in rows}
    assert len(out) == len(rows)
    return out


def files(table):
    out = {}
    for b, v in table.state().items():
        out[b] = {(p.name, p.stat().st_mtime_ns) for p in Path(table.path, "data", v, f"bucket={b}").glob("*.parquet")}
    return out


def test_only_touched_buckets_change(spark, tmp_path):
    table, want = made(spark, tmp_path / "t")
    assert content(table) == want
    before = files(table)
    batch = spark.createDataFrame([(1, 0, "new"), (1, 7, "more"), (500, 0, "first"), (1, 0, "newer")], ROWS)
    touched = table.upsert(batch, ["doc_id", "chunk_index"])
    want |= {(1, 0): "newer", (1, 7): "more", (500, 0): "first"}
    assert content(table) == want and 1 <= len(touched) <= 2
    after = files(table)
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert content(KeyedTable(spark, table.path)) == want
    table.upsert(batch, ["doc_id", "chunk_index"])  # run again
    assert content(table) == want


def test_a_write_that_fails_is_invisible(spark, tmp_path, monkeypatch):
    table, want = made(spark, tmp_path / "t")
    answers = iter([table.version(), "v9"])
    monkeypatch.setattr(table, "version", lambda: next(answers))
    with pytest.raises(RuntimeError, match="another write"):
        table.upsert(spark.createDataFrame([(1, 0, "lost")], ROWS), ["doc_id", "chunk_index"])
    assert content(KeyedTable(spark, table.path)) == want and len(list(Path(table.path, "data").iterdir())) == 2


def test_replace_insert_and_delete(spark, tmp_path):
    table, want = made(spark, tmp_path / "t")
    batch = spark.createDataFrame([(2, 0, "only"), (9, 9, "of no document to replace")], ROWS)
    table.replace_documents(batch, spark.createDataFrame([(2,), (3,), (777,)], "doc_id int"))
    want = {k: v for k, v in want.items() if k[0] not in (2, 3)} | {(2, 0): "only"}
    assert content(table) == want
    table.insert_ignore(spark.createDataFrame([(2, 0, "there already"), (3, 5, "new")], ROWS), ["doc_id", "chunk_index"])
    want[3, 5] = "new"
    assert content(table) == want
    table.delete(spark.createDataFrame([(k,) for k in range(20)], "doc_id int"))  # buckets may end without rows
    assert content(table) == {}
    assert table.upsert(spark.createDataFrame([], ROWS), ["doc_id", "chunk_index"]) == []
    with pytest.raises(ValueError, match="lacks columns"):
        table.upsert(batch, ["chunk_index"])
    with pytest.raises(Exception):
        KeyedTable(spark, str(tmp_path / "none"))
