"""Fuzzy and containment joins against brute force, and how many pairs they look at."""

import random
from collections import Counter

import pytest

from tallyfold.operators import resolve


def dice(a, b):
    grams = lambda s: Counter(k[i : i + 2] for k in ["".join(c for c in s.lower() if c.isascii() and c.isalnum())] for i in range(len(k) - 1))
    x, y = grams(a), grams(b)
    return round(2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())), 6) if x or y else 0.0


def near_names(n, seed, letters="abcde"):
    rng, out = random.Random(seed), []
    while len(out) < n:
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        out.append(s)
        if rng.random() < 0.6:
            k = rng.randrange(len(s))
            out.append(s[:k] + rng.choice(letters) + s[k + rng.randrange(2) :])
    return out[:n]


@pytest.mark.parametrize("floor", [0.5, 0.7, 0.8, 1.0])
def test_fuzzy_equals_all_pairs(spark, floor):
    queries, names = near_names(150, 1) + ["", "a", "aaaa", "aaaaaaa", "A-a A", "é"], near_names(200, 2) + ["aa", "aaaaa", "", "aaaaaaaaaaaa"]
    want = {(q, f"c{n}", dice(q, n)) for q in queries for n in names if dice(q, n) >= floor}
    got = resolve.fuzzy(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(f"c{n}", n) for n in names], "canonical string, name string"), floor)
    assert set(map(tuple, got.collect())) == want != set()


def test_fuzzy_checks_few_pairs_of_many_names(spark):
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    base = ["".join(rng.choices(letters, [26 - k for k in range(26)], k=rng.randrange(10, 22))) for _ in range(8_000)]
    typo = lambda s: (lambda k: s[:k] + rng.choice("012") + s[k + 1 :])(rng.randrange(len(s)))
    queries = spark.createDataFrame([(typo(s),) for s in base[:4_000]], "query string")
    names = spark.createDataFrame([(s,) for s in base], "name string")
    pairs = resolve.fuzzy_candidates(queries, names, 0.7).count()
    results = resolve.fuzzy(queries, names.selectExpr("name as canonical", "name"), 0.7).count()
    assert 3_600 < results <= pairs < 12 * results < 0.002 * 4_000 * 8_000


def brute_labels(labels, synonyms):
    import re

    plain = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip(" ")
    out = set()
    for x in set(labels):
        t, found = f" {plain(x)} ", []
        for canonical, name in set(synonyms):
            s = f" {plain(name)} "
            if s in t or t in s:
                found.append((-(1.0 if s == t else 0.9), -len(s), s, canonical, name))
        if found:
            best = min(found)
            out.add((x, best[3], best[4], -best[0]))
    return out


def test_containment_equals_all_pairs(spark):
    rng = random.Random(7)
    words = ["net", "total", "revenue", "of", "the", "cost", "a", "sales", "tax", "rate"]
    text = lambda n: rng.choice([" ", "-", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    labels = [text(6) for _ in range(150)] + ["", "!!", "Net  Revenue", "unknown"]
    synonyms = [(f"c{k % 7}", text(4)) for k in range(60)] + [("z", ""), ("y", "net revenue of the whole year 2020"), ("w", "Total: Net")]
    got = resolve.map_labels(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(synonyms, "canonical string, name string"))
    assert set(map(tuple, got.collect())) == brute_labels(labels, synonyms)


def test_pairs_of_a_frequent_word_stay_few(spark):
    labels = spark.createDataFrame([(f"total item{k}", ["total", f"item{k}"]) for k in range(3000)], "label string, a array<string>")
    names = spark.createDataFrame([(f"total item{k}", ["total", f"item{k}"]) for k in range(3000)], "name string, b array<string>")
    assert resolve.keyed_by_rarest(names, labels, "b", "a").count() == 3000
