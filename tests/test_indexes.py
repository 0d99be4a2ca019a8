"""Indexes that are written once and searched many times: vectors and words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import search, vector_index
from tallyfold.operators.text_index import TextIndex
from tallyfold.operators.vector_index import InvertedFile

VECTORS = "id long, v array<double>"


def clustered(n, width=12, groups=15, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    x = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, width))
    x[n - copies :] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def exact(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in asked:
        s = x @ (np.array(v) / np.linalg.norm(v))
        order = [j for j in np.lexsort((ids, -s.round(9))) if ids[j] != i][:k]
        out[i] = [round(float(s[j]), 6) for j in order]
    return out


def scores(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(round(r.score, 6))
    return out


def test_inverted_file_is_exact_when_asked_to_be(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 150)
    rows = clustered(1500, copies=500)
    v = spark.createDataFrame(rows, VECTORS)
    index = InvertedFile.build(v, str(tmp_path / "index"), lists=20)
    assert len(index.lists) == 20 and max(index.parts.values()) >= 4  # the copies' list is in parts
    asked = rows[::100]
    queries = spark.createDataFrame(asked, VECTORS)
    got = index.search_exact(queries, 7, probes=1)
    assert scores(got) == exact(rows, asked, 7)
    assert all(r.query_id != r.id for r in got.collect())


def test_inverted_file_recall_and_lists_read(spark, tmp_path):
    """The registered query, with its own parameters and queries, against exact search; and
    the index is opened again by its path."""
    from tallyfold.plans.text import P, vectors

    sf = "/root/testdata/sf0.01"
    v = vectors(spark, sf)
    q = v.filter("id % 100 = 0")
    want = {(r.query_id, r.id) for r in search.vector_top_k(q, v, 5).collect()}
    got = {(r.query_id, r.id) for r in P.queries["k7_inverted_file"](spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want) > 0
    InvertedFile.build(v, str(tmp_path / "index"))
    index = InvertedFile(spark, str(tmp_path / "index"))
    plan = index.search(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "dynamicpruning" in plan
    assert 1 < index.tuned(5, 0.5) < index.tuned(5) < len(index.lists)
    assert {(r.query_id, r.id) for r in index.search(q, 5, index.tuned(5)).collect()} == got


def test_inverted_file_grows(spark, tmp_path):
    rows = clustered(900, seed=4)
    index = InvertedFile.build(spark.createDataFrame(rows[:600], VECTORS), str(tmp_path / "index"), lists=12)
    index.add(spark.createDataFrame(rows[600:], VECTORS))
    asked = rows[5::90]
    assert scores(index.search_exact(spark.createDataFrame(asked, VECTORS), 5, probes=1)) == exact(rows, asked, 5)
    again = InvertedFile(spark, str(tmp_path / "index"))
    assert scores(again.search_exact(spark.createDataFrame(asked, VECTORS), 5, probes=2)) == exact(rows, asked, 5)


def test_inverted_file_of_odd_vectors(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    empty = InvertedFile.build(none, str(tmp_path / "none"))
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0])], VECTORS)
    assert empty.search(some, 3).count() == 0 and empty.search_exact(some, 3).count() == 0
    index = InvertedFile.build(some, str(tmp_path / "some"))
    got = {(r.query_id, r["rank"], r.id) for r in index.search_exact(some, 3, probes=1).collect()}
    assert got == {(1, 1, 2), (1, 2, 7), (2, 1, 1), (2, 2, 7), (7, 1, 1), (7, 2, 2)}
    assert index.search(none, 3).count() == 0


def test_a_half_written_index_is_none(spark, tmp_path):
    (tmp_path / "log").mkdir()
    with pytest.raises(ValueError, match="no whole version"):
        from tallyfold.sources.tables import read_newest

        read_newest(spark, str(tmp_path))


# --- words ---------------------------------------------------------------------------


def chunk_rows(n=300, seed=2):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(40)] + ["Net", "revenue", "grew", "été", "x-y"])
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 12), p=weights / weights.sum()))
        rows.append((k // 3, k % 3, text + (" " + "pad " * 300 if k % 17 == 0 else ""), f"s{k % 4}" if k % 11 else None, f"u{k % 2}", f"t{k % 5}"))
    return rows


CHUNKS = "doc_id long, chunk_index int, content string, section_type string, subsection string, ticker string"


def asked_rows(seed=3):
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    phrases = ["w0 w1 w0 w2", "0 w0 W1 w", "net revenue grew", "w3", "absent words here", "grew   w0 w1 w1", "", None, "longsingleword", "w2 w0 w0 w0"]
    return [(k, phrases[k % len(phrases)], ["zzz"] if k % 6 == 5 else [f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 4))] + (["zzz"] if k % 7 == 0 else []) + (["w1", "w1"] if k % 9 == 0 else []), pick(["s0", "s1", None, "none"]), pick(["u0", None]), pick(["s2", None]), pick(["t1", None, None])) for k in range(60)]


ASKED = "query_id long, phrase string, terms array<string>, section string, subsection string, suggested string, ticker string"


def rows_of(found):
    return sorted(map(tuple, found.select("query_id", "doc_id", "chunk_index", "stage", "score").collect()))


def test_word_index_gives_the_rows_of_a_full_search(spark, tmp_path):
    rows = chunk_rows()
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked_rows(), ASKED)
    index = TextIndex.build(chunks.filter("doc_id < 60"), str(tmp_path / "index"), buckets=8)
    index.add(chunks.filter("doc_id >= 60"))
    want = rows_of(search.search_chunks(queries, chunks, 4))
    assert {r[3] for r in want} == {1, 2, 3, 4, 5, 6}
    assert rows_of(index.search(queries, 4)) == want
    assert rows_of(TextIndex(spark, str(tmp_path / "index")).search(queries, 4)) == want


def test_word_index_without_scope_columns_or_rows(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "the one text"), (1, 1, None)], "doc_id long, chunk_index int, content string")
    queries = spark.createDataFrame([(1, "", ["one"]), (2, "", ["none"]), (3, "", [])], "query_id long, phrase string, terms array<string>")
    index = TextIndex.build(chunks, str(tmp_path / "a"))
    assert [r[:4] for r in rows_of(index.search(queries, 3))] == [(1, 1, 0, 2)]
    assert index.search(queries.limit(0), 3).count() == 0


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame(chunk_rows(), CHUNKS), str(tmp_path / "index"), buckets=16)
    words = spark.createDataFrame([("w1", 1)], "term string, query_id int")
    read = index._of(words, ["query_id"])
    assert len({f.split("bucket=")[1].split("/")[0] for f in index.postings.inputFiles()}) > 8
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "PartitionFilters" in plan
    assert read.count() == sum("w1" in r[2].split() for r in chunk_rows())


def test_a_word_of_a_chunk_takes_no_work_on_the_chunk(spark, tmp_path, monkeypatch):
    """Chunks are worked out once, and what holds for one is not written with each word."""
    from tallyfold.operators import text_index

    monkeypatch.setattr(text_index, "PART_CHUNKS", 100)
    seen, rows = spark.sparkContext.accumulator(0), chunk_rows()

    def counted(row):
        seen.add(1)
        return row

    chunks = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(counted), CHUNKS)
    index = TextIndex.build(chunks, str(tmp_path / "index"), buckets=4)
    assert seen.value == len(rows)
    assert set(index.postings.columns) == {"doc_id", "chunk_index", "term", "bucket"}
    files = [f.split("bucket=")[1].split("/")[0] for f in index.postings.inputFiles()]
    assert 4 < len(files) <= 4 * 4  # several tasks for a bucket
    queries = spark.createDataFrame(asked_rows(), ASKED)
    assert rows_of(index.search(queries, 4)) == rows_of(search.search_chunks(queries, spark.createDataFrame(rows, CHUNKS), 4))
