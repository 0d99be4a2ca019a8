"""Samples, sums and runs that must not grow with partitions or with a text's length."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tagger(spark):
    from tallyfold.llm import pii

    return pii.train(*pii.labelled_windows(spark.read.parquet(f"{SF}/documents.parquet"), 300), steps=60)


def test_lowest_hands_on_few_rows(spark):
    from tallyfold.llm.common import low_hashes, lowest

    rows = spark.range(0, 50_000, 1, 40)
    passed = low_hashes(rows, 100, "id").count()
    assert 200 < passed < 800
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert [r.id for r in lowest(rows, 100, "id").collect()] == want
    assert lowest(rows.limit(0), 5, "id").count() == 0 and lowest(rows.limit(7), 5, "id").count() == 5


@pytest.mark.parametrize("letters", ["0123456789", "0123456789abcdef"])
def test_marginals_of_a_long_stretch_are_probabilities(tagger, letters):
    from tallyfold.llm import pii

    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(100_000))
    starts = list(pii.window_starts(0, len(text)))
    emit = np.concatenate([tagger.emissions(np.array([pii.codes(text[s : s + pii.WINDOW]) for s in starts[k : k + 512]])).swapaxes(0, 1)[:, : pii.STRIDE] for k in range(0, len(starts), 512)]).reshape(-1, len(pii.TAGS) + 1)
    fwd, back, whole = pii.crf_marginals(emit[:, None].astype(np.float64), tagger.p["pair"].astype(np.float64))
    assert np.abs(np.exp(fwd + back - whole[:, None]).sum(2) - 1).max() < 1e-6
    began = time.time()
    found = pii.found_by(tagger, [text])[0]
    assert all(0 <= a < b <= len(text) for _, a, b in found) and time.time() - began < 60


def test_many_spans_in_one_run_cost_its_length_once():
    from tallyfold.llm import pii

    text = "x " + "7" * 20_000 + " y"
    began = time.time()
    pii.added(text, [], [("phone", a, a + 9) for a in range(2, 20_000, 20)])
    assert time.time() - began < 1
    rng = random.Random(2)
    for _ in range(300):  # the remembered runs change nothing
        text = "".join(rng.choice("12 .a@-") for _ in range(60))
        runs = {}
        for _ in range(6):
            a = rng.randrange(58)
            span = (rng.choice(["email", "phone", "card", "secret"]), a, rng.randrange(a + 1, 60))
            assert pii.widened(text, *span, runs) == pii.widened(text, *span)


def test_top_k_over_many_partitions(spark):
    from tallyfold.llm import vector_search

    rows = vector_search.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = sorted(map(tuple, vector_search.top_k(rows.filter("vec_id % 100 = 0"), rows).collect()))
    many = rows.repartition(40)
    assert sorted(map(tuple, vector_search.top_k(many.filter("vec_id % 100 = 0"), many).collect())) == want


def test_score_column_that_differs_in_case(spark):
    from tallyfold.llm import quality

    docs = spark.createDataFrame([(1, "text", 0.5)], "doc_id long, text string, Score double")
    model = quality.fit_pairs(np.zeros((0, quality.N_FEATURES)), np.zeros(0))
    with pytest.raises(ValueError, match="already"):
        quality.score(docs, model)


def test_quality_weights_agree_with_descent_on_all_pairs():
    """Bradley-Terry by sampled pairs against plain descent over every pair."""
    from tallyfold.llm import quality

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.normal(size=80) * 0.5 > 0).astype(int)
    model = quality.fit_pairs(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) + 1e-4 * w)
    a, b = z @ model.weights, z @ w
    assert np.corrcoef(a, b)[0, 1] > 0.99
    right = max(((b >= c) == (y == 1)).mean() for c in b)
    assert (((model.scores(x) >= quality.CUT_SCORE)) == (y == 1)).mean() >= right - 0.03


def test_decontamination_blocks_by_items_and_by_bytes(spark, monkeypatch):
    from tallyfold.llm import decontaminate as op

    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = []
    monkeypatch.setattr(op.Items, "__init__", lambda self, ids, *a, own=op.Items.__init__: (blocks.append(len(ids)), own(self, ids, *a))[1])
    want = sorted(op.find(docs, items).collect())
    assert want and blocks == [items.select("item_id", "text").distinct().count()]
    n, size = items.select("item_id", "text").distinct().agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    for name, value in (("BLOCK_ITEMS", n // 3 + 1), ("BLOCK_BYTES", size // 3 + 1)):
        blocks.clear()
        with monkeypatch.context() as m:
            m.setattr(op, name, value)
            assert sorted(op.find(docs, items).collect()) == want
        assert len(blocks) == 3 and sum(blocks) == n and max(blocks) < n


def test_packing_looks_up_a_few_megabytes_at_once():
    import pyarrow as pa

    from tallyfold.llm import packing
    from tallyfold.llm.common import slices

    texts = [f"{k} " + "x" * 99_990 for k in range(300)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[k : k + 10]}) for k in range(0, 300, 10)]
    got = list(slices(packing.together(iter(batches)), "text", packing.BLOCK_BYTES))
    assert [t for b in got for t in b["text"].to_pylist()] == texts
    assert max(b.nbytes for b in got) < 8_000_000 and len(got) < 10


def test_packing_holds_the_ids_of_few_words_at_once():
    import numpy as np
    import pyarrow as pa

    from tallyfold.llm import packing

    texts = pa.array([f"text {k} " + "the of and a " * 250 for k in range(400)])
    encode = packing.word_pieces(packing.TOKENIZER)
    parts = [(flat, edges) for flat, edges in encode(texts)]
    assert sum(len(edges) - 1 for _, edges in parts) == 400
    assert max(len(flat) for flat, _ in parts) < 120_000
    assert (np.concatenate([flat for flat, _ in parts]) == np.concatenate([flat for flat, _ in encode(texts, 10**9)])).all()


def test_rows_travel_in_batches_of_two_megabytes(spark):
    """Larger buffers are beyond the executors' pool and stay with it, outside the heap."""
    from tallyfold.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(2**23))
    small_batches(spark)
    assert int(spark.conf.get(key)) <= 2**21
    rows = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 500000)").alias("text"))
    sizes = rows.mapInArrow(lambda it: (b.select(["text"]).from_pydict({"n": [b.nbytes]}) for b in it), "n long").toPandas()["n"]
    assert sizes.sum() >= 20_000_000 and sizes.max() <= 2**21 + 600_000
    spark.conf.set(key, str(2**20))
    small_batches(spark)
    assert spark.conf.get(key) == str(2**20)
    spark.conf.unset(key)
