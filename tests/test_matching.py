"""Greedy paragraph matching by rounds of joins against the pass it stands for."""

import random
import time

import pytest

from tallyfold.operators import narrative


def brute(pairs):
    used, out = set(), set()
    for key in {p[0] for p in pairs}:
        for old in sorted({p[1] for p in pairs if p[0] == key}):
            left = [(-s, new) for k, o, new, s in pairs if k == key and o == old and (key, new) not in used]
            if left:
                s, new = min(left)
                used.add((key, new))
                out.add((key, old, new, -s))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_matches_equal_the_pass(spark, seed):
    rng = random.Random(seed)
    pairs = {(k, o, n): rng.choice([0.75, 0.8, 0.9, 1.0]) for k in range(12) for o in range(8) for n in range(8) if rng.random() < 0.5}
    pairs = [(*k, s) for k, s in pairs.items()] + [(99, o, n, 1.0) for o in range(6) for n in range(6)]
    got = narrative.greedy_matches(spark.createDataFrame(pairs, "key int, old int, new int, similarity double"), "key")
    assert set(map(tuple, got.collect())) == brute(pairs)
    assert narrative.greedy_matches(spark.createDataFrame([], "key int, old int, new int, similarity double"), "key").count() == 0


def jaccard(a, b):
    a, b = ({w for w in t.lower().split() if len(w) > 2} for t in (a, b))
    return round(len(a & b) / len(a | b), 6) if a | b else 1.0


def test_paragraphs_equal_the_pass(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "omega", "sigma", "kappa", "a", "theta"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
    docs = []
    for k in range(25):
        old = [line() for _ in range(rng.randrange(1, 7))]
        new = [rng.choice(old) if rng.random() < 0.6 else line() for _ in range(rng.randrange(1, 7))]
        docs.append((k, "\n\n".join(old), "\n\n".join(new)))
    want = set()
    for k, a, b in docs:
        x, y = ([(i, t) for i, t in enumerate(__import__("re").split(r"\n\n+", c)) if t.strip(" ")] for c in (a, b))
        hit = brute([(k, i, j, jaccard(s, t)) for i, s in x for j, t in y if jaccard(s, t) > 0.7])
        want |= {(k, o, n, "modified" if s < 0.95 else "unchanged", s) for _, o, n, s in hit}
        want |= {(k, i, None, "removed", None) for i, _ in x if i not in {h[1] for h in hit}} | {(k, None, j, "added", None) for j, _ in y if j not in {h[2] for h in hit}}
    df = spark.createDataFrame(docs, "id int, a string, b string")
    got = narrative.diff_paragraphs(df.selectExpr("id", "a as content"), df.selectExpr("id", "b as content"), "id")
    assert set(map(tuple, got.select("id", "old", "new", "change", "similarity").collect())) == want


def test_repeated_paragraphs_take_one_pass(spark):
    """Hundreds of equal lines in one document, which took a round of jobs each."""
    lines = ["one and the same line", "another line of text here", "", "..."] * 300
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join([lines[1], *lines[:900]])), (2, None, "only new"), (3, "only old", None)], "id int, a string, b string")
    out = narrative.diff_paragraphs(df.selectExpr("id", "a as content"), df.selectExpr("id", "b as content"), "id", r"\n")
    got = out.collect()
    assert sum(r.change == "unchanged" for r in got) == 225 + 226 + 225 and sum(r.change == "removed" for r in got if r.id == 1) == 900 - 676
    assert sum(r.change == "added" for r in got if r.id == 1) == 0
    assert [(r.old, r.new, r.change) for r in sorted(got, key=lambda r: r.id) if r.id > 1] == [(None, 0, "added"), (0, None, "removed")]
    assert min((r.old, r.new) for r in got if r.id == 1 and r.new == 0) == (1, 0)


def test_guidance_equals_one_pattern(spark):
    """The first sentence with a key word as the pattern over the whole text finds it, and
    a long text without a full stop is read once, not from each of its characters."""
    from pyspark.sql import functions as F

    texts = ["We expect growth. More.", "none. Our OUTLOOK\nis weak. We expect.", "unexpected things. forecasts rise", ".. guidance.", "expect", "", None, " a.b expect c.d", "reforecast. x-forecast."]
    df = spark.createDataFrame([("t", i, 0, t) for i, t in enumerate(texts)], "ticker string, doc_id int, chunk_index int, content string")
    plain = F.trim(F.regexp_extract("content", r"(?i)([^.]*\b(?:expect|anticipate|outlook|guidance|forecast)\w*\b[^.]*\.)", 1))
    want = sorted((r.doc_id, r.g) for r in df.select("doc_id", plain.alias("g")).filter("g <> ''").collect())
    assert sorted((r.doc_id, r.guidance) for r in narrative.guidance(df, ["growth"], ["weak"]).collect()) == want != []
    long = spark.createDataFrame([("t", 0, 0, "word " * 40_000)], df.schema)
    started = time.monotonic()
    assert narrative.guidance(long, ["growth"], ["weak"]).count() == 0
    assert time.monotonic() - started < 20


def test_year_ends_meet_in_parts(spark, monkeypatch):
    """Tickers of few days are dealt, and each pair is found once."""
    import datetime

    from tallyfold.operators import peers

    monkeypatch.setattr(peers, "PART", 7)
    ends = [datetime.date(2001, m, d) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    rows = [(f"t{i:02}", ends[i * i % 4 if i % 3 else i % 4]) for i in range(40)]
    out = peers.fy_mismatch(spark.createDataFrame(rows, "ticker string, year_end date"))
    gap = lambda a, b: min(abs(a - b), 365 - abs(a - b))
    day = {t: e.timetuple().tm_yday for t, e in rows}
    assert sorted(map(tuple, out.collect())) == sorted((a, b, gap(day[a], day[b])) for a in day for b in day if a < b and gap(day[a], day[b]) > 60)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_year_ends_meet_without_a_shuffle_per_pair(spark, monkeypatch, sent):
    """Tickers are sent whole while they are few bytes, else dealt by two ranges; missing
    days and tickers, repeated tickers and a limit below any gap are as in SQL."""
    import datetime

    from tallyfold.operators import peers

    monkeypatch.setattr(peers, "PART", 11)
    monkeypatch.setattr(peers, "SENT", sent)
    monkeypatch.setattr(peers, "PACK", 3)
    ends = [datetime.date(y, m, d) for y in (2000, 2001) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    rows = [(f"t{i * 7 % 60:02}", ends[i * i % 8 if i % 3 else i % 8]) for i in range(60)] + [("t07", ends[0]), ("t07", ends[1]), ("t08", None), (None, ends[2]), ("é", ends[3]), ("T", ends[6])]
    known = [(t, e.timetuple().tm_yday) for t, e in rows if t and e]
    gap = lambda a, b: min(abs(a - b), 365 - abs(a - b))
    for limit in (60, -2):
        out = peers.fy_mismatch(spark.createDataFrame(rows, "ticker string, year_end date"), limit)
        assert sorted(map(tuple, out.collect())) == sorted((a, b, gap(x, y)) for a, x in known for b, y in known if a < b and gap(x, y) > limit)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" in plan) == (sent == 0)
    none = peers.fy_mismatch(spark.createDataFrame([], "ticker string, year_end date"))
    assert none.collect() == [] and none.columns == ["a", "b", "gap"]
