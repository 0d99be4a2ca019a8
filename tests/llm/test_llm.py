"""The first ten operators on small inputs: brute force, round trips, odd rows."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b c d e f", "a b c d e f", "Ünïcode — text, with marks!", "x" * 5000, "word " * 3000, "a b c d e f"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD)] + [(5, "a b c d e f", "en", "s", 11), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(sets: dict) -> dict:
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for a, b in {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


# --- 6 -------------------------------------------------------------------------------


@pytest.mark.parametrize(("large", "share"), [(8, 0.03), (2, 0.6)])
def test_near_join_equals_brute_force(spark, monkeypatch, large, share):
    from tallyfold.llm import near_join

    monkeypatch.setattr(near_join, "LARGE", large)
    monkeypatch.setattr(near_join, "LED_SHARE", share)
    rng = np.random.default_rng(1)
    common = [f"c{k}" for k in range(60)]
    rows, base = [], [f"w{k}" for k in range(90)]
    for k in range(60):  # near copies at several distances, and strangers with one passage
        w = list(base) if k < 40 else [f"s{k}.{j}" for j in range(20)] + common
        for j in rng.choice(len(w), rng.integers(0, 6), replace=False):
            w[j] = f"x{k}.{j}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components({i: shingle_set(t) for i, t in rows})
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_join.groups(docs).collect()}
    assert got == {i: (want[i], len(shingle_set(t))) for i, t in rows}
    assert len(set(want.values())) < len(rows)


@pytest.mark.parametrize("part", [4096, 3])
def test_near_join_of_ids_with_different_texts(spark, monkeypatch, part):
    from tallyfold.llm import near_join

    monkeypatch.setattr(near_join, "PART", part)
    monkeypatch.setattr(near_join, "LOCAL_COUNT", 2)
    w = [f"b{k}" for k in range(40)]
    near = [*w[:39], "other"]
    a = " ".join(f"a{k}" for k in range(40))
    rows = [(1, a), (5, a), (5, " ".join(w)), (9, " ".join(near)), (9, " ".join(near)), (11, "x y z"), (None, a)]
    rows += [(20 + k, " ".join([*w[:30], *(f"z{k}.{j}" for j in range(10))])) for k in range(12)]
    got = near_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None and r.doc_id < 20) == [(1, 1), (5, 1), (5, 1), (9, 1), (9, 1), (11, 11)]
    assert all(r.component_id == r.doc_id for r in got if r.doc_id and r.doc_id >= 20)


def test_near_join_of_shared_boilerplate_makes_no_pairs(spark):
    """Texts that share three of four shingles, too few for a link, meet nowhere."""
    from tallyfold.llm import near_join

    rows = [(k, f"all of these words are the same w{k}") for k in range(3000)] + [(10_000 + k, " ".join([*(f"c{j}" for j in range(60)), *(f"u{k}.{j}" for j in range(20))])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scanned = near_join.scan(docs)
    often = near_join.frequent(scanned)
    none = scanned.select("doc_id", "print").limit(0)
    n, pos = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(2**32 - 1).cast("int")
    alone = near_join.prefixes(docs, none, often).select("token", "doc_id", n.alias("n"), pos.alias("pos"), F.col("doc_id").alias("component"))
    assert alone.groupBy("token").count().agg(F.max("count")).first()[0] >= 3000
    assert near_join._met(alone).count() == 0
    got = near_join.groups(docs)
    assert got.filter("component_id <> doc_id").isEmpty() and got.count() == 3500


def test_near_join_meets_members_once_not_in_each_bucket(spark, monkeypatch):
    """Texts close to a group of near copies, but not linked, share many early tokens with
    each member: one row a pair, and the same components as with a row a token."""
    from tallyfold.llm import near_join

    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(12)]
    rows += [(20 + k, " ".join([*base[:95], *(f"s{k}.{j}" for j in range(25))])) for k in range(6)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_components({i: shingle_set(t) for i, t in rows})
    made, paired = [], near_join._paired

    def counted(near, buckets):
        made.append(paired(near, buckets).count())
        return paired(near, buckets)

    monkeypatch.setattr(near_join, "_paired", counted)
    for listed in (64, 0):
        monkeypatch.setattr(near_join, "LISTED", listed)
        assert {r.doc_id: r.component_id for r in near_join.groups(docs).collect()} == want
    assert 0 < made[0] <= 12 * 6 < made[1]


def test_near_join_size_bands_are_safe(spark):
    from tallyfold.llm import near_join

    n = spark.range(1, 4000).select(F.col("id").alias("n"), near_join.band(F.col("id")).alias("b"))
    got = n.select("n", "b", near_join.least_shared(F.lit(10**6), F.col("b")).alias("a"), near_join.least_shared(F.col("n"), F.col("b")).alias("own")).collect()
    assert all(x.b <= y.b for x, y in itertools.pairwise(got))
    assert all(r.own <= r.n and (r.n > 16 or r.own == -(-75 * 2 * r.n // 175)) for r in got)


def test_near_join_odd_rows(odd, none):
    from tallyfold.llm import near_join

    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_join.groups(odd).collect()]
    assert len(got) == odd.count()
    by = dict((i, (n, c)) for i, n, c in got)
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[3] == (1, 3) and by[4] == (2, 4) and by[5] == (2, 4) and by[9] == (2, 4)
    assert by[None] == (1, None)
    assert near_join.groups(none).count() == 0


# --- 3 -------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyfold.llm import packing

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(packing.cut(docs)).toPandas()
    for doc, rows in got.groupby("doc_id"):
        ids = np.array([*tok.encode(ODD[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        rows = rows.sort_values("piece")
        assert rows.length.sum() == len(ids) and rows.piece.tolist() == list(range(-(-len(ids) // 4096)))
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)
    assert packing.pack(packing.cut(none)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    from tallyfold.llm.packing import best_fit

    lengths = np.sort(np.random.default_rng(0).integers(1, 60, 400))[::-1]
    bins = best_fit(lengths, 100, 4, 3000.0, (1.0, 0.2, 0.5), rule)
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert len(mine) == 1 or (mine.sum() <= 100 and len(mine) <= 4 and (mine.astype(float) ** 2).sum() <= 3000)


def test_word_pieces_equal_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyfold.llm import packing

    lib, rnd = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), random.Random(4)
    own = packing.WordPieces(lib, limit=500)
    parts = [*"aBé.,!'#1²Ǆʰ… <|>İΣ\n\x1c\x85", "'s", "<|endoftext|>", "don't", "\t", "\u00a0", "\u2028"]
    letters = [chr(c) for c in range(0x30, 0x400) if chr(c).isalpha()] + ["a", "e", "n", "th"] * 100
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    texts = words + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)] + ["", " ", "a " * 9000, "b" * 9000, "." * 9000]
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        got = [ids[a:b].tolist() for ids, edges in own(pa.array(some), words=900) for a, b in itertools.pairwise(edges)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_groups_stay_even(spark):
    """Rows without an id, or all alike, are dealt over the groups like any."""
    from tallyfold.llm import packing

    one = "cast(null as long) as doc_id, 0 as piece, 0L as start, 4L as length, 7L as ids_crc32"
    got = packing.pack(spark.range(60_000).selectExpr(*one.split(", ")), group_pieces=6000)
    sizes = [r["count"] for r in got.groupBy((got.sequence_id / 2**32).cast("int").alias("g")).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 60_000 and max(sizes) < 7000


# --- 1 -------------------------------------------------------------------------------


def test_language_model_gradient():
    from tallyfold.llm import language_model as lm

    rng = np.random.default_rng(0)
    p = {k: rng.normal(size=s) * 0.3 for k, s in lm.SHAPES.items()}
    ids, prev, h = rng.integers(0, lm.START, (5, 3)), rng.integers(0, lm.START + 1, (5, 3)), np.zeros((3, lm.SIZE))
    prev[2, 1] = lm.START
    _, g, _ = lm.gradient(ids, prev, h, p)
    for k, a in p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        keep = a[at]
        a[at] = keep + 1e-3
        up = lm.gradient(ids, prev, h, p)[0]
        a[at] = keep - 1e-3
        down = lm.gradient(ids, prev, h, p)[0]
        a[at] = keep
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=1e-2, abs=1e-5)


def test_language_model_windows_and_base(spark, none):
    import math

    from tallyfold.llm import language_model as lm

    rng = np.random.default_rng(0)
    p = {k: (rng.normal(size=s) * 0.3).astype(np.float32) for k, s in lm.SHAPES.items()}
    texts = [rng.integers(0, lm.START, n) for n in (1, 7, 200, 33)]
    whole = [lm.text_log_probs([t], p, window=500)[0] for t in texts]
    assert lm.text_log_probs(texts, p, group=2, window=5) == pytest.approx(whole, rel=1e-4)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.op1_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").toPandas()
    counts = Counter()
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*t.encode().lower().split(), b"\n"])
    n, v = counts.total(), len(counts)
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        w = [*t.encode().lower().split(), b"\n"]
        r = got.loc[i]
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    counted = lm.count_words(none)
    v0 = lm.vocabulary(counted)
    assert lm.score(none, counted, v0, lm.train(none, v0)).count() == 0


def test_language_model_reads_every_text(spark):
    """A round covers all texts, however large the corpus is."""
    from tallyfold.llm import language_model as lm

    texts = [f"a{k} b{k % 3} c" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    v = lm.vocabulary(lm.count_words(docs))
    v.tokens = 10**9
    p = lm.fresh(v)
    for k in range(lm.ROUNDS):
        net = lm.Trainer(p, 0.012 / (1 + k))
        net.read([lm.token_ids(lm.words(t.encode()), v.index) for t in texts])
        p = net.p
    assert lm.flatten(lm.train(docs, v)) == pytest.approx(lm.flatten(p), abs=1e-4)


def test_language_model_counts_the_end_of_few_long_texts(spark, monkeypatch):
    """The end is known even where all its count band is beyond the most frequent words."""
    import math

    from tallyfold.llm import language_model as lm

    monkeypatch.setattr(lm, "TOP_WORDS", 50)
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300)))], "doc_id long, text string")
    counts = lm.count_words(docs).cache()
    v = lm.vocabulary(counts)
    r = lm.score(docs, counts, v, lm.fresh(v)).first()
    assert v.top == {lm.END: 1} and (r.n_tokens, r.n_known) == (301, 301)
    assert r.base_score == pytest.approx(301 * math.log10(1.5 / (301 + 0.5 * 302)))
    assert r.score == pytest.approx(r.base_score, rel=0.02)


def test_language_model_splits_each_text_once(spark, odd):
    """The rounds and the scores read numbers that are written once; these are the words'."""
    import pyarrow as pa

    from tallyfold.llm import language_model as lm

    raws = [b"", b" ", b" A b\x0bC\x0c ", b"\x1cab \x85 x\x00y", "\u00dcn\u00ef\u00a0\u00c4 b\u2003c".encode(), b"a\r\n\tB "]
    flat, lens = lm.tokens(pa.array(raws, pa.binary()).slice(1))
    assert flat.to_pylist() == [w for r in raws[1:] for w in lm.words(r)] and lens.tolist() == [len(lm.words(r)) for r in raws[1:]]

    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    v = lm.vocabulary(lm.count_words(docs))
    for rows in (docs, docs.limit(0)):
        got = lm.encode(rows, v).collect()
        want = [lm.token_ids(lm.words((r.text or "").encode()), v.index).tolist() for r in rows.collect()]
        assert sorted(np.frombuffer(r.ids, np.uint16).tolist() for r in got) == sorted(want)
    p = lm.learn(lm.encode(docs, v), v, 1)
    assert lm.flatten(lm.train(docs, v, 1)) == pytest.approx(lm.flatten(p), abs=1e-5)


def test_language_model_averages_in_two_steps(spark, monkeypatch):
    from tallyfold.llm import language_model as lm

    docs = spark.createDataFrame([(k, f"a{k} b{k % 3} c " * (1 + k)) for k in range(40)], "doc_id long, text string").repartition(6, "doc_id").cache()
    v = lm.vocabulary(lm.count_words(docs))
    one = lm.flatten(lm.train(docs, v, 1))
    monkeypatch.setattr(lm, "FAN_IN", 2)
    assert lm.flatten(lm.train(docs, v, 1)) == pytest.approx(one, abs=1e-5)


def test_unigram_model_is_the_start():
    from tallyfold.llm import language_model as lm

    top = {lm.END: 3, b"a": 5, b"b": 2}
    v = lm.Vocabulary(10, 3, top, {lm.END: 0, b"a": 1, b"b": 2}, np.full(lm.RARE_CLASSES, 0.5))
    lp = lm.log_probs(np.zeros((3, lm.SIZE), np.float32), np.array([0, 1, 2]), lm.fresh(v))
    assert np.exp(lp) == pytest.approx(np.array([3.5, 5.5, 2.5]) / (11.5 + 0.5 * lm.RARE_CLASSES), rel=1e-4)


# --- 2 -------------------------------------------------------------------------------


def every_window(op, known, words):
    """The best dice of any window, by template name, without any pruning."""
    numbers = known.bigrams(known.numbers(words))
    at = np.searchsorted(known.known, numbers)
    grams = [int(i) if i < len(known.known) and known.known[i] == g else -1 for i, g in zip(at, numbers, strict=True)]
    best = Counter()
    for name, counts, size in zip(known.names, known.counts, known.sizes.tolist(), strict=True):
        for i in range(len(grams)):
            left, shared = dict(counts), 0
            for j in range(i, min(len(grams), i + 2 * size)):
                if left.get(grams[j], 0) > 0:
                    left[grams[j]] -= 1
                    shared += 1
                best[name] = max(best[name], 2 * shared / (j - i + 1 + size))
    return best


def test_license_scan_equals_all_windows():
    from tallyfold.llm import licenses as op

    rng = np.random.default_rng(0)
    texts = {"a": ["the work may be used by any person for any purpose but not sold"], "b": ["all rights are kept"], "c": ["any person may use the work and any person may copy the work"]}
    known = op.Templates(texts)
    pool = sorted({w for t in texts.values() for w in t[0].split()}) + ["x", "y"]
    missed = 0
    for _ in range(300):
        words = [str(w) for w in rng.choice(pool, rng.integers(2, 30))]
        if rng.random() < 0.8:
            copy = texts[str(rng.choice(list(texts)))][0].split()
            for i in rng.choice(len(copy), rng.integers(0, 3)):
                copy[i] = str(rng.choice(pool))
            words = words[:10] + copy + words[10:]
        best = every_window(op, known, words)
        got = {m[0]: m[1] for m in known.matches(words)}
        assert all(best[k] >= d - 1e-9 and d >= op.MIN_DICE - 1e-9 for k, d in got.items())
        missed += bool(got) != any(d >= op.MIN_DICE - 1e-9 for d in best.values())
    assert missed <= 3


def test_license_scan_finds_whole_texts_and_parts_of_lines(spark, odd, none):
    from tallyfold.llm import licenses as op

    whole = op.templates()
    apache, mit = next(t for t in whole["Apache-2.0"] if len(t) > 5000), next(t for t in whole["MIT"] if len(t) > 900)
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 20)
    texts = ["Released under the MIT License.", "RELEASED!! under the *MIT* license", "a repo. Released under the MIT License. And more words", "x = 1\n" * 40 + apache + "\ny = 2" * 40, apache + "\n" + mit, "code();\n" + edited + "\nmore();", "nothing here"]
    rows = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "Apache-2.0"), (4, "MIT"), (5, "MIT")}
    at = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in rows}
    assert at[2] == "Released under the MIT License" and at[3].startswith("Apache License") and at[3].endswith("limitations under the License")
    assert op.scan(odd).count() == 0 and op.scan(none).count() == 0


def test_license_scan_of_long_texts_takes_linear_time():
    import time

    from tallyfold.llm import licenses as op

    known = op.Templates(op.templates())
    words = op._WORD.findall(op.lowered(" ".join(t for some in op.templates().values() for t in some)))
    parts = [words[i : i + 3] for i in range(0, len(words), 3)]
    np.random.default_rng(0).shuffle(parts)
    began = time.process_time()
    known.matches([w for p in parts * 4 for w in p])
    assert time.process_time() - began < 20


# --- 4 -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav>a<p>b</nav>", ""), ("just text", "just text"),
        ("<body><nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>One.<p>Two <b>bo</b>ld.<script>if (a<b) {}</script></article><footer>c</footer>", "T & U One. Two bold."),
        ("<main><p>Kept.</p><aside>no</aside><form>no</form><div class='ad box'>no</div><div id=comments><p>no, no, no.</p></div></main>", "Kept."),
        ("<div id=sidebar><p>no</p></div><div class=post><p>Long enough, is it not, to be the text of a page.</p><p>Short.</p></div><p class=cookie-notice>no</p>", "Long enough, is it not, to be the text of a page. Short."),
        ("<div class='site has-sidebar'><article><p>One text, here.</p></article></div>", "One text, here."),
        ("<div class='main no-comments'><article><h2 id='related-work'>Related</h2><p class='notice-of-sale'>One text, here.</p></article></div>", "Related One text, here."),
        ("<section id='search-methods'><h1>T</h1><p>One text, here, and more of it.</p></section>", "T One text, here, and more of it."),
        ("<article><p>Main text, it is.</p></article><section class='comments'><article class='comment'><p>" + "I like it, really. " * 30 + "</p></article></section>", "Main text, it is."),
        ("<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>text, a b c.</p><ul><li>x</li></ul><footer>tags</footer></article></main>", "T text, a b c. x"),
        ("<ul><li><a href=/>Home</a></li><li><a>link</a></li></ul><div><h1>Title</h1><p>" + "Some words, more. " * 9 + "</p><ul><li>item</li></ul><p>End.</p></div><div>(c) site</div>", "Title " + "Some words, more. " * 9 + "item End."),
        ("<form><div id=header>no</div><div><p>A sentence, with words.</p></div></form>", "A sentence, with words."),
        ("<p>a < b and c <3", "a < b and c <3"), ("<p title='a>b'>x</p><p title='unclosed>y</p>", "x y"),
    ],
)
def test_html_content(page, text):
    from tallyfold.llm.html_extract import content

    assert content(page or "") == text


@pytest.mark.parametrize(
    ("block", "text"),
    [
        ('<script src=/js/>alert("no")</script>', ""), ("<style media=/x/>p{}</style>", ""), ("<iframe src=/a/>no</iframe>", ""), ("<noscript/>no</noscript>", ""), ("<svg/>yes", "yes"), ("<svg a=/x/>no</svg>", ""),
        ("<noscript>yes", "yes"), ("<title>no<p>yes</p>", "yes"), ("<script>no</SCRIPT >yes", "yes"), ("<object><p>yes</p></object>", "yes"),
        ('<p data-2="hidden cost">yes</p>', "yes"), ("<p data-x=hidden @b:c_d='hidden'>yes</p>", "yes"), ("<p hidden>no</p>", ""), ("<p HIDDEN=''>no</p>", ""),
        ('<section id="navigation-systems"><p>yes</p></section>', "yes"), ('<p class="comment-worthy">yes</p>', "yes"), ('<section class="menu-of-the-day"><p>yes</p></section>', "yes"), ('<p class="ad-hoc">yes</p>', "yes"), ("<div class='layout-with-sidebar'>yes</div>", "yes"),
        ('<div class="share-this">no <a>no</a></div>', ""), ('<div class="related-content"><p>no, no</p></div>', ""), ('<div class="discussion"><p>no, no</p></div>', ""), ('<div class="replies"><p>no, no</p></div>', ""),
        ('<div class="comment__body"><p>no, no</p></div>', ""), ('<div class="cookie-law-info">no</div>', ""), ('<div id="ad-300x250">no</div>', ""), ('<div class="menu-of-links"><a>no</a> <a>no</a></div>', ""),
        ('<section id="discussion"><h2>yes</h2><p>yes</p></section>', "yes yes"), ("<div><a>no</a></div><div><a>no</a></div>", ""), ("<h2><a>yes</a></h2><h2><a>yes</a></h2>", "yes yes"), ("<p><a>yes</a></p>", "yes"),
    ],
)
def test_html_blocks_inside_an_article(block, text):
    from tallyfold.llm.html_extract import content

    some = "A long paragraph of words, and more of it. " * 8
    got = content(f"<article><p>{some}</p>{block}<p>{some}</p></article>")
    assert got == " ".join(f"{some} {text} {some}".split())


def test_html_threshold_decides():
    import pyarrow.parquet as pq

    from tallyfold.llm.html_extract import content

    pages = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    assert sum(content(p or "") != content(p or "", spread=-1e9) for p in pages) > 0.9 * len(pages)


def test_html_path_values_equal_plain_sums():
    from tallyfold.llm import html_extract as op

    page = op.parse("<div class=a><p>One, two.</p><p>Three <a>four</a>.</p><ul><li>x</li><li>y, z</li></ul></div><nav><p>m</p></nav><div class=b>w</div>")
    got = op.path_values(page)
    # paths in order: text length, punctuation, share of links, blocks, parent, prior
    rows = [(len("One, two.") + len("Three") + len("four") + 1, 3, 4 / 19, 2, "a", 1), (5, 1, 0, 2, "ul", 1), (1, 0, 0, 1, "nav", op.OF_FURNITURE), (1, 0, 0, 1, "", 1)]
    text, mark = ([r[k] * (1 - (r[2] if k == 0 else 0)) / r[3] for r in rows] for k in (0, 1))
    want = []
    for i, r in enumerate(rows):
        w = [np.exp(-((i - j) ** 2) / 2) * (1 if r[4] == q[4] else op.APART) * (abs(i - j) <= 2) for j, q in enumerate(rows)]
        t, m = (sum(a * b for a, b in zip(w, x, strict=True)) / sum(w) for x in (text, mark))
        want.append(np.sqrt(t * (1 + m)) * r[5])
    assert got.value[got.used] == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "</b>" * 100_000, '<a "' * 100_000, "<a href='" * 50_000, "<!" * 100_000, "<p><b>" * 50_000, "<article>" * 50_000 + "x", "<p><button>" + "<b>" * 4000 + "<div></div>" * 20_000, "<ul>" + "<li>a, b.<ul>" * 30_000, "<svg>" * 100_000, "<script>" + "</script" * 100_000, "<p " + "a='" * 100_000 + ">", "<p " + "a  " * 100_000 + ">"])
def test_html_reads_any_page_in_linear_time(page):
    import time

    from tallyfold.llm.html_extract import content

    began = time.process_time()
    content(page)
    assert time.process_time() - began < 10


def test_html_table(spark):
    from tallyfold.llm import html_extract

    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", "<p>a b</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()) == [(1, "", 0), (1, "a b", 3)]
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------


def test_chat_paths_on_trees(spark):
    from tallyfold.llm import chat

    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, 0.9), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    messages = spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double").na.fill({"text": ""})
    got = {(r.conv_id, r["rank"]): chat.parsed(r.formatted) for r in chat.conversations(messages, top=2).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "good"), ("user", "")], (1, 2): [("user", "q"), ("assistant", "bad")], (2, 1): [("user", "orphan")]}


def test_chat_long_chain_and_empty(spark):
    from tallyfold.llm import chat

    rows = spark.createDataFrame([(7, k, "assistant" if k % 2 else "user", f"</s>\\{k}") for k in range(100)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.conversations(chat.linear(rows))).collect()
    assert len(r) == 1 and r[0].n_turns == 100
    learnt = "".join(f"</s>\\{k}" for k in range(1, 100, 2))
    assert r[0].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and r[0].loss_chars == len(learnt)
    assert chat.conversations(chat.linear(rows.limit(0))).count() == 0


# --- 7 -------------------------------------------------------------------------------


def test_pii_spans(spark, odd, none):
    import re

    from tallyfold.llm import pii

    text = "a@b@c.de x1@y-z.co.uk 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 x4111 1111 1111 1111 +49 (30) 123456-78 +1 2"
    base = pii.base_spans(text)
    want = []
    for kind, p in pii.PATTERNS.items():
        want += [(kind, *m.span()) for m in re.finditer(p, text) if pii.holds(kind, m[0])]
    assert base == want and [k for k, _, _ in base] == ["email", "email", "ip", "ip", "ip", "card", "phone"]
    docs = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    out = pii.redact(docs, None).first()
    assert out.text.startswith("a@[EMAIL] [EMAIL] [IP] 999.1.1.1 ") and out.n_chars == len(out.text)
    assert pii.detect(odd, None).count() == odd.count() and pii.train(*pii.labelled_windows(none)) is None


def test_pii_addresses_equal_the_pattern():
    import random
    import re

    from tallyfold.llm import pii

    rnd = random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice(["1", "25", "300", ".", ".", "..", " ", "x", "007"]) for _ in range(rnd.randrange(30)))
        want = [("ip", *m.span()) for m in re.finditer(pii.PATTERNS["ip"], t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[0] == "ip"] == want


@pytest.mark.parametrize("text", ["1" * 5000 + ".1.1.1", "1" * 200_000 + " x.", "+" + "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000, "key = " + "a1" * 100_000, "dot " * 50_000])
def test_pii_reads_long_runs_in_linear_time(text):
    import time

    from tallyfold.llm import pii

    began = time.process_time()
    known = pii.base_spans(text) + pii.secrets(text)
    pii.added(text, known, [("email", 0, 9), ("phone", 10, 20)])
    assert time.process_time() - began < 3


@pytest.fixture(scope="module")
def tagger(spark):
    from tallyfold.llm import pii

    return pii.train(*pii.labelled_windows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_pii_tagger_adds_what_no_pattern_matches(spark, tagger):
    from tallyfold.llm import pii

    hidden = ["anna.schmidt (at) example (dot) org", "joe.miller at mail dot example dot com", "(030) 555-123-4567", "0049 30 5551 2345", "10 . 20 . 30 . 40", "192[.]168[.]4[.]20", "5425.2334.3010.9903", "tom@mail . example . net", "jane_doe [at] web [dot] de", "030/5551/2345", "4539-1488/0343/6467", "0 171 555 12 34"]
    clean = ["we met on 2024-05-17 at noon, 12:30:15, and paid 1,234,567.89 for No. 8007782375593431", "look at the dot on the i and at page 12 of 300", "It was 3.5 or 4, not 17."]
    rows = [(k, f"hinganly reea {t} thandwh of it") for k, t in enumerate(hidden)] + [(100 + k, t) for k, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs, tagger).collect()}
    assert all(r.base_sha256 == pii.digest([]) and r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in got.values())
    assert sum(got[k].n_spans == 1 for k in range(len(hidden))) >= len(hidden) - 2 and all(got[100 + k].n_spans == 0 for k in range(len(clean)))
    out = {r.doc_id: r.text for r in pii.redact(docs, tagger).collect()}
    for k, t in enumerate(hidden):
        assert (t in out[k]) == (got[k].n_spans == 0)
    assert [out[100 + k] for k in range(len(clean))] == clean


def test_pii_secrets_have_columns_of_their_own(spark):
    from tallyfold.llm import pii

    docs = spark.createDataFrame([(1, 'my token = "2321bac4d15ec8f90433955b" and a@b.de'), (2, "total = 2321222222222222222")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs, None).collect()}
    assert (got[1].spans, got[1].secrets, got[1].n_secrets) == ("email:42:48", "secret:12:36", 1) and got[2].n_secrets == 0
    assert {r.text for r in pii.redact(docs, None).collect()} == {'my token = "[SECRET]" and [EMAIL]', "total = 2321222222222222222"}


def test_pii_tagger_learns(spark):
    from tallyfold.llm import pii

    x, y = pii.labelled_windows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    cut = len(x) * 3 // 4
    net = pii.train(x[:cut], y[:cut], steps=120)
    emit = net.emissions(x[cut:])
    path = np.array([pii.viterbi(emit[:, k], net.p["pair"]) for k in range(emit.shape[1])])
    there = y[cut:] > 0
    assert (path[there] == y[cut:][there]).mean() > 0.6 and (path == y[cut:]).mean() > 0.9


def test_crf_gradient():
    from tallyfold.llm import pii

    rng = np.random.default_rng(0)
    net = pii.Tagger.fresh(width=4, size=3)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    x, y = rng.integers(0, pii.N_CHARS, (2, 6)), rng.integers(0, len(pii.TAGS) + 1, (2, 6))
    _, g = net.gradient(x, y)
    for k, a in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        keep, e = a[at], 1e-5
        a[at] = keep + e
        up = net.gradient(x, y)[0]
        a[at] = keep - e
        down = net.gradient(x, y)[0]
        a[at] = keep
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], rel=1e-4)


# --- 8 -------------------------------------------------------------------------------


def test_alignment_equals_the_plain_table():
    from tallyfold.llm.decontaminate import GAP, MATCH, MISS, smith_waterman

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64)
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i, j in itertools.product(range(1, len(b) + 1), range(1, len(a) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if b[i - 1] == a[j - 1] else MISS), h[i - 1, j] - GAP, h[i, j - 1] - GAP)
        assert smith_waterman([a, a[:1]], [b, b])[0] == h.max()


def test_decontamination_finds_edited_copies(spark, odd, none):
    from tallyfold.llm import decontaminate as op

    item = " ".join(f"t{k}" for k in range(40))
    edited = item.split()
    edited[5:7] = ["new"]
    edited[20] = "other!!"
    rows = [(1, "x y z " + item.upper() + " end"), (2, "p " * 50 + " ".join(edited)), (3, " ".join(item.split()[:10])), (4, "nothing of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in op.find(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0 and got[2, 7] > 0.8
    assert op.find(none, bench).count() == 0 and op.find(docs, bench.limit(0)).count() == 0 and op.find(odd, bench).count() == 0


def test_decontamination_of_items_with_odd_ids(spark):
    from tallyfold.llm import decontaminate as op

    docs = spark.createDataFrame([(1, "p q one two three four five six r"), (2, "s seven eight nine ten eleven twelve t"), (3, "none null id text of the bench here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five six"), (7, "seven eight nine ten eleven twelve"), (None, "null id text of the bench")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.find(docs, bench).collect()} == {(1, 7), (2, 7), (3, None)}


def test_decontamination_equals_aligning_all_pairs(spark):
    """Copies with every 4th word changed, with words put in, and with a single 3-gram."""
    from tallyfold.llm import decontaminate as op

    rng = np.random.default_rng(1)
    items = [[f"w{x}" for x in rng.integers(0, 300, m)] for m in (1, 2, 3, 4, 5, 9, 16, 30, 59)]
    docs = [[f"w{x}" for x in rng.integers(0, 300, 80)] for _ in range(20)]
    for t in items:
        docs += [["x", *(f"n{k}" if (k + p) % 4 == 0 else w for k, w in enumerate(t)), "y"] for p in range(4)]
        docs.append([x for w in t for x in (w, "in")][:-1])
        docs += [[w for w in t if rng.random() < 0.7 for w in ([w, "in"] if rng.random() < 0.3 else [w])] for _ in range(10)]
    docs.append([w if c == "M" else "x" for w, c in zip(items[5], "MMMxMMxMM", strict=True)])
    number: dict = {}
    hashed = [[np.array([number.setdefault(w, len(number)) for w in op.normalised(" ".join(t).encode())]) for t in x] for x in (docs, items)]
    want = {}
    for (i, d), (k, t) in itertools.product(enumerate(hashed[0]), enumerate(hashed[1])):
        share = float(op.smith_waterman([d], [t])[0]) / (op.MATCH * len(t)) if len(d) else 0.0
        if share >= op.MIN_SCORE:
            want[i, k] = share
    assert (len(docs) - 1, 5) in want
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in op.find(rows, bench).collect()} == want


# --- 9 -------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    from tallyfold.llm import quality

    got = quality.op9_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    j = labels.join(got, "doc_id")
    j = j[j.held_out]
    assert (j.predicted == j.quality).mean() > 0.93 and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_cut_where_most_labels_are_bad():
    from tallyfold.llm import quality

    rng = np.random.default_rng(0)
    for good in (5, 100, 500, 900):
        y = (np.arange(1000) < good).astype(int)
        x = rng.normal(size=(1000, quality.N_FEATURES))
        x[:, 0] += 12 * y
        assert ((quality.fit_pairs(x, y).scores(x) >= quality.CUT_SCORE) == (y == 1)).mean() > 0.99


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_pipeline_keeps_documents_without_both_labels(spark, tmp_path, labels):
    import corpus_pipeline

    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "A clean text."), (2, "Another one."), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.rate(spark, docs, str(tmp_path)).collect()) == [1, 2, 3]


def test_quality_odd_rows(spark, odd, none):
    from tallyfold.llm import quality

    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, nobody)).collect()} == {0.5}
    with pytest.raises(ValueError):
        quality.score(odd.withColumn("score", F.lit(1)), quality.fit(odd, nobody))
    model = quality.fit(odd, spark.createDataFrame([(4, 1), (8, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0


# --- 10 ------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    from tallyfold.llm import vector_search as op

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 20)), 1).astype(np.float32)
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [float("nan")] * 20, 0), (302, [None] * 20, 0), (303, [float("inf")] * 20, 0), (304, [0.5], 0), (305, [], 0), (7, rows[7][1], 0)]
    usable = op.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op.top_k(usable.filter("vec_id % 100 = 0"), usable).collect()]
    v = {(k, i): np.pad(np.floor(1024 * np.array(e, np.float32).astype(float)), (0, 20 - len(e))) for k, (i, e, _) in enumerate(rows) if e is not None and all(c is not None and np.isfinite(c) for c in e)}
    want = []
    for (_, q), a in v.items():
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for (_, i), b in v.items() if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert op.top_k(usable.limit(0), usable.limit(0)).count() == 0


def test_top_k_of_many_queries(spark, monkeypatch):
    """More queries than a block holds are dealt by groups, with the same result."""
    from tallyfold.llm import vector_search as op

    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (3000, 8))
    rows = spark.createDataFrame([(int(i), [float(c) / 1024 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    usable = op.usable(rows)
    monkeypatch.setattr(op, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(op, "ROW_BLOCK", 500)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in op.top_k(usable.filter("vec_id % 2 = 0"), usable, 3).collect()}
    s = x @ x.T
    for q in range(0, 3000, 2):
        order = [i for i in np.lexsort((np.arange(3000), -s[q]))[:4].tolist() if i != q][:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, s[q, i]) for i in order]
    assert len(got) == 4500


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_decides_rows_by_their_texts(spark, tmp_path):
    """Ids that repeat or are missing, clashing columns, null and empty texts, no rows."""
    import corpus_pipeline as cp

    a, b = (" ".join(f"{p}{k}" for k in range(30)) for p in "ab")
    item = " ".join(f"t{k}" for k in range(12))
    cols = "doc_id long, text string, score double, row_number_ int, component_id string"
    rows = [(1, a), (1, b), (None, a), (None, f"x {item} y"), (2, b), (3, None), (3, ""), (4, "call +1 (555) 123-4567 now"), (4, "call +1 (555) 123-4567 now")]
    docs = spark.createDataFrame([(*r, 0.5, k, "c") for k, r in enumerate(rows)], cols)
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        kept, left = table, []
        for _, stage in cp.STAGES[:-1]:
            kept = cp.materialize(stage(spark, kept, str(tmp_path)), "t")
            assert kept.schema == docs.schema
            left.append(sorted(r.row_number_ for r in kept.collect()))
        if table is docs:
            assert left[0] == [*range(9)] and left[1][:6] == [0, 1, 3, 5, 6, 7] and len(left[1]) == 6 and left[2] == left[3] == [0, 1, 5, 6, 7]
            assert kept.filter("row_number_ = 7").first().text == "call [PHONE] now"
        assert cp.STAGES[-1][1](spark, kept, str(tmp_path)).count() == len(left[-1])


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = cp.materialize(stage(spark, kept, SF), "t")
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= before
        if name == "n-gram Jaccard join":
            want = brute_components({i: shingle_set(texts[i]) for i in before})
            assert set(after) == {i for i in before if want[i] == i}
    packed = cp.STAGES[-1][1](spark, kept, SF).toPandas()
    assert set(packed.doc_id) == set(after) and packed.groupby("sequence_id").length.sum().max() <= 4096
