"""N-gram Jaccard join: prefix filters under several global token orders.

A document is its set of hashed five-word shingles. Two sets with Jaccard >= 3/4 must
share a token among the first ``n - ceil(3n/4) + 1`` tokens of both, under *any* global
order. Candidates come from one order by an equi-join; they are verified only if they
also share a prefix token under every other order.

Steps, each written once to shared storage:

1. a scan gives each document's set size and 128-bit set fingerprint, and counts that
   stand out locally; equal sets form one class, represented by its smallest id;
2. the orders put tokens of high corpus frequency last (at most ``MAX_FREQUENT`` of
   them are sent to the tasks) and the others by a hash, a different one per order;
3. prefix tokens of the first order meet in buckets; buckets of tokens known to be
   frequent are split. First members of a bucket are compared with its smallest member
   if that leads them in enough buckets, so k near copies cost about k pairs, and
   components are formed; this repeats a few times with other members of a bucket's
   largest component for those still outside. Then documents of one bucket that are in
   different components meet if their sizes and the token's place in both sets still
   allow a link: a bucket is dealt into pairs of size bands, and into each goes only the
   part of the prefix that two sets of such sizes must share; where they meet, the two
   sizes themselves are asked. So texts that share most of their words, but too few for
   a link, do not meet there. The tokens shared by the pairs that do are counted on whole
   prefixes, the pairs are compared if the count allows a link, and components are
   formed again. A link that is never compared lies inside a component already, so the
   components are exact.

Results on odd input: null, empty and blank texts have no shingles and stand alone; a
text of fewer than five words is one shingle; a very long one is one large set like any;
repeated rows give repeated result rows; rows of one id with different texts are one node
with the links of each; a row without an id has a null component; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import WordHasher, materialize, mix64, most_frequent, shingles, slices, table, text_bytes, words
from tallyfold.llm.components import components

WIDTH = 5
NEED, OF = 75, 100  # link when OF * intersection >= NEED * union
ORDERS = 3
MAX_FREQUENT = 2**17
LOCAL_COUNT, BLOCK = 6, 2_000_000
LED_SHARE = 0.03  # of a set: tokens a leader must share; the others are decided later
MORE_LEADS = 1  # rounds of comparing with one member of the largest component
LARGE = 8  # members from which a component is met as a whole first
LISTED = 64  # members up to which those near a large component are then paired with each
BROADCAST_IDS = 2_000_000
PART = 4096  # documents of a frequent token that are kept together
FEW, RATIO = 16, 1.15  # set sizes with a band of their own; growth of the bands beyond


def _sets(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in parts of bounded size, with the set of each row."""
    hasher = WordHasher()
    for batch in slices(it, "raw"):
        yield batch, [shingles(hasher(words(raw)), width) for raw in batch["raw"].to_pylist()]


def _print(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def prefix_length(n: np.ndarray | int, need: int = NEED, of: int = OF):
    return n + (-need * n) // of + 1  # n - ceil(need * n / of) + 1


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(_long(flat), pa.int64()))


def scan(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of two kinds: each document's size and set fingerprint (token null), and
    tokens with how many documents of a block have them, from LOCAL_COUNT on."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(ids, sizes, prints, tokens, counts):
            pad = [None] * len(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([*ids, *pad], pa.int64()), pa.array([*sizes, *pad], pa.int64()), pa.array([*prints, *pad], pa.binary()), pa.array([*[None] * len(ids), *tokens], pa.int64()), pa.array([*[None] * len(ids), *counts], pa.int64())],
                names=["doc_id", "n_shingles", "print", "token", "n"],
            )

        def common():
            got, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return out([], [], [], _long(got[n >= LOCAL_COUNT]).tolist(), n[n >= LOCAL_COUNT].tolist())

        for batch, sets in _sets(it, width):
            held += sets
            yield out(batch["doc_id"].to_pylist(), [len(s) for s in sets], [_print(s) for s in sets], [], [])
            if sum(map(len, held)) > BLOCK:
                yield common()
        if held:
            yield common()

    schema = "doc_id long, n_shingles long, print binary, token long, n long"
    return docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(run, schema)


def frequent(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and their counts: at most MAX_FREQUENT.
    They only steer the order, so leaving some out costs time, never a link."""
    counts = scanned.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= 2 * LOCAL_COUNT)
    top = most_frequent(materialize(counts, "frequent"), MAX_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(tokens)
    return tokens[at], top["n"].to_numpy(np.int64)[at]


def prefix(s: np.ndarray, order: int, often: tuple[np.ndarray, np.ndarray], need: int = NEED, of: int = OF) -> np.ndarray:
    """The first tokens of a set under one of the orders."""
    if not len(s):
        return s
    key = mix64(s + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(1)
    tokens, counts = often
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        hit = tokens[at] == s
        rank = np.minimum(counts[at[hit]], 2**24).astype(np.uint64)
        key[hit] = np.uint64(2**63) | (rank << np.uint64(38)) | (key[hit] >> np.uint64(25))
    return s[np.argsort(key, kind="stable")[: prefix_length(len(s), need, of)]]


def part_of(tokens: np.ndarray, doc: int | None, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which part of each token's bucket a document is in: -1 where the token is not known
    to be frequent and its bucket is not split."""
    out = np.full(len(tokens), -1, np.int32)
    known, counts = often
    if len(known) and len(tokens) and doc is not None:
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hit = np.flatnonzero((known[at] == tokens) & (counts[at] > PART))
        if len(hit):
            out[hit] = mix64(np.array([doc], np.int64).view(np.uint64))[0] % (counts[at[hit]] // PART + 1).astype(np.uint64)
    return out


def prefixes(docs: DataFrame, copies: DataFrame, often: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """(token, part, place, doc_id): the prefix under the first order, one row per token, of
    all (doc_id, print) but ``copies``. ``place`` holds the set size and the position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(it, width):
            ids = batch["doc_id"].to_pylist()
            first = [prefix(s, 1, often) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
            part = np.concatenate([part_of(f, i, often) for f, i in zip(first, ids, strict=True)])
            place = np.concatenate([(len(s) << 32) + np.arange(len(f)) for s, f in zip(sets, first, strict=True)])
            rows = pa.StructArray.from_arrays([pa.array(_long(np.concatenate(first))), pa.array(part), pa.array(place.astype(np.int64))], names=["token", "part", "place"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_print(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, rows)], names=["doc_id", "print", "t"])

    rows = docs.filter("doc_id is not null").select("doc_id", text_bytes().alias("raw")).mapInArrow(run, "doc_id long, print binary, t array<struct<token:long,part:int,place:long>>")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(copies) if few else copies, ["doc_id", "print"], "left_anti")
    return rows.select("doc_id", F.inline("t")).select("token", "part", "place", "doc_id")


def whole_sets(docs: DataFrame, ids: DataFrame, often: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """Sets and the other orders' prefixes, of the documents named in ``ids``."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = docs.select("doc_id", text_bytes().alias("raw")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(it, width):
            more = [_lists([prefix(s, k, often) for s in sets]) for k in range(2, ORDERS + 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _lists(sets), *more], names=["doc_id", "tokens", *(f"p{k}" for k in range(2, ORDERS + 1))])

    cols = "".join(f", p{k} array<long>" for k in range(2, ORDERS + 1))
    return named.mapInArrow(run, f"doc_id long, tokens array<long>{cols}")


def sizes_allow(a, b):
    """A set too small for the other cannot reach the threshold."""
    return OF * F.least(a, b) >= NEED * F.greatest(a, b)


def prefixes_allow(shared, a, b):
    """Of two prefixes, all tokens of the one that ends first, in the global order, that
    the other set has at all are in the other prefix too. So the intersection is at most
    the shared prefix tokens plus what follows the prefix of that set."""
    rest = F.greatest(*(F.ceil(NEED * n / OF) - 1 for n in (a, b)))
    return shared + rest >= F.ceil(NEED * (a + b) / (OF + NEED))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every other order and whose
    exact Jaccard reaches the threshold."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in sets.columns if c != "doc_id")), side)
    for k in range(2, ORDERS + 1):
        pairs = pairs.filter(F.arrays_overlap(f"a_p{k}", f"b_p{k}"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - both
    return pairs.filter(OF * both >= NEED * union).select("a", "b")


def links(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(documents with set size and class representative, links between ids that span
    every component)."""
    docs = docs.select("doc_id", "text")
    scanned = materialize(scan(docs, width), "sets")
    often = frequent(scanned)
    rows = scanned.filter("token is null").select("doc_id", "n_shingles", "print")
    classes = rows.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("first"))
    members = rows.join(classes, "print", "left").select("doc_id", "n_shingles", "print", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("first"))
    members = materialize(members, "members")
    copies = members.filter("doc_id <> first").select("doc_id", "print").distinct()
    # an id with different texts ties the classes of each together
    ties = members.groupBy("doc_id").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter("lo <> hi").select("doc_id")
    ties = members.join(ties, "doc_id", "left_semi").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()

    # most tokens are one document's alone: they go before anything else is asked of a bucket
    by_part = W.partitionBy("token", "part")
    shared = prefixes(docs, copies, often, width).withColumn("k", F.count("*").over(by_part)).filter("k > 1 or part >= 0").distinct()
    n, pos = F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(2**32 - 1).cast("int").alias("pos")
    buckets = materialize(shared.select("token", "doc_id", n, pos, (F.col("part") >= 0).alias("hot")), "buckets")

    # every bucket has one lead, so near copies have the same one in all of theirs; at most
    # MAX_FREQUENT tokens are hot: their leads travel to the rows, not the rows to them
    least = F.min(F.struct("doc_id", "n"))
    cold = buckets.filter("not hot").withColumn("lead", least.over(W.partitionBy("token")))
    hot = buckets.filter("hot").join(F.broadcast(buckets.filter("hot").groupBy("token").agg(least.alias("lead"))), "token")
    led = cold.unionByName(hot.select(*cold.columns)).select("lead", F.struct("doc_id", "n").alias("own"))
    led = led.filter("own.doc_id <> lead.doc_id").filter(sizes_allow(F.col("own.n"), F.col("lead.n")))
    star = led.groupBy(F.col("lead.doc_id").alias("a"), F.col("own.doc_id").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("own.n", "lead.n")).alias("n"))
    star = materialize(star.filter(F.col("shared") >= LED_SHARE * F.col("n")).select("a", "b"), "star")
    found = ties.unionByName(_compared(docs, star, often, width))

    for k in range(MORE_LEADS):
        lead = _led_again(_mixed(buckets, components(found)), k).join(star, ["a", "b"], "left_anti")
        lead = materialize(lead, "star")
        star, found = star.unionByName(lead), found.unionByName(_compared(docs, lead, often, width))

    comps = components(found)
    rest = _undecided(_mixed(buckets, comps), comps).join(star, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    return members, found.unionByName(_compared(docs, rest, often, width))


def _compared(docs: DataFrame, pairs: DataFrame, often: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return materialize(verified(pairs, whole_sets(docs, ids, often, width)), "links")


def _mixed(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Buckets with members of several components, each row with its own and the
    bucket's largest one."""
    named = buckets.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    by_token = W.partitionBy("token")
    cold = named.filter("not hot").withColumn("lo", F.min("component").over(by_token)).withColumn("hi", F.max("component").over(by_token))
    # at most MAX_FREQUENT tokens are hot: their ends travel to the rows, not the rows to them
    hot = named.filter("hot")
    hot = hot.join(F.broadcast(hot.groupBy("token").agg(*ends)), "token").select(*cold.columns)
    mixed = materialize(cold.unionByName(hot).filter("lo <> hi").drop("lo", "hi"), "mixed")
    largest = mixed.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("major"))
    return mixed.join(largest, "token")


def _led_again(mixed: DataFrame, k: int) -> DataFrame:
    """Strangers of each bucket with another member of its largest component, the one
    of lowest hash in round ``k``: most late members of a large group of near copies
    join it here, at one pair each."""
    leads = mixed.filter("component = major").groupBy("token").agg(F.min_by(F.struct("doc_id", "n"), F.struct(F.xxhash64("doc_id", F.lit(k)), "doc_id")).alias("lead"))
    led = mixed.filter("component <> major").join(leads, "token").filter(sizes_allow(F.col("n"), F.col("lead.n")))
    ends = [F.least("doc_id", "lead.doc_id").alias("a"), F.greatest("doc_id", "lead.doc_id").alias("b")]
    counted = led.groupBy(*ends).agg(F.count("*").alias("shared"), F.min(F.least("n", "lead.n")).alias("n"))
    return counted.filter(F.col("shared") >= LED_SHARE * F.col("n")).select("a", "b")


def _undecided(mixed: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of one bucket in different components that a link is possible for.

    Against a component of LARGE members or more, a document is first counted as a
    whole: the buckets it shares with any member bound those it shares with one. Most
    strangers in the buckets of a large group fall here, at one row per bucket.
    """
    large = comps.groupBy("component").count().filter(F.col("count") >= LARGE).select("component", F.lit(True).alias("large"), (F.col("count") <= LISTED).alias("listed"))
    rows = mixed.drop("major").join(large, "component", "left").na.fill(False, ["large", "listed"])
    rows = materialize(rows, "mixed")
    x = rows.select("token", *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "component", "large")))

    whole = rows.filter("large").groupBy("token", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # of two large components only the later one's documents are counted
    meet = x.join(whole, "token").filter("x_component <> component and (not x_large or x_component > component)")
    near = meet.groupBy("x_doc_id", "x_n", "component").agg(F.count("*").alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = F.greatest("lo", F.ceil(NEED * F.col("x_n") / OF)), F.least("hi", F.floor(OF * F.col("x_n") / NEED))
    least = lambda n: NEED * (F.col("x_n") + n) / (OF + NEED) - NEED * F.greatest("x_n", n) / OF
    near = near.filter(lo <= hi).filter(F.col("shared") >= F.least(least(lo), least(hi))).select("x_doc_id", "x_n", "component")
    near = materialize(near.join(large.select("component", "listed"), "component"), "near")
    pairs = _paired(near, rows).distinct().unionByName(_met(rows.filter("not large")))
    # all that are left are counted on whole prefixes, by 31 bits of each token; ``twice``
    # is what a document's tokens that are alike there could add to its count
    bits = F.collect_list(F.col("token").bitwiseAND(2**31 - 1).cast("int"))
    prefixes_ = rows.groupBy("doc_id", "n").agg(bits.alias("p"))
    own = prefixes_.select(F.col("doc_id").alias("x_doc_id"), F.col("n").alias("x_n"), F.col("p").alias("x_p"), (F.size("p") - F.size(F.array_distinct("p"))).alias("twice"))
    pairs = pairs.join(own, ["x_doc_id", "x_n"]).join(prefixes_, ["doc_id", "n"])
    pairs = pairs.filter(prefixes_allow(F.size(F.array_intersect("x_p", "p")) + F.col("twice"), F.col("x_n"), F.col("n")))
    return pairs.select(F.least("doc_id", "x_doc_id").alias("a"), F.greatest("doc_id", "x_doc_id").alias("b")).distinct()


def _paired(near: DataFrame, rows: DataFrame) -> DataFrame:
    """(x_doc_id, x_n, doc_id, n): each document near a large component, with every member
    that its size allows if these are few, once and not in each bucket they share; of a
    larger component with those members that it shares an early token with."""
    ends = ("x_doc_id", "x_n", "doc_id", "n")
    members = rows.filter("listed").select("component", "doc_id", "n").distinct()
    listed = near.filter("listed").join(members, "component").filter(sizes_allow(F.col("n"), F.col("x_n"))).select(*ends)
    left = near.filter("not listed").select(F.col("x_doc_id").alias("doc_id"), F.col("x_n").alias("n"), F.col("component").alias("met"))
    x = _dealt(rows.drop("component").join(left, ["doc_id", "n"])).select("token", F.col("own").alias("lo"), F.col("other").alias("hi"), F.col("met").alias("component"), *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "pos")))
    y = _dealt(rows.filter("large and not listed")).select("token", F.col("other").alias("lo"), F.col("own").alias("hi"), "component", "doc_id", "n", "pos")
    return listed.unionByName(x.join(y, ["token", "lo", "hi", "component"]).filter(_early()).select(*ends))


def band(n):
    """Size band: sizes up to FEW each have their own, later ones grow by RATIO."""
    n = n.cast("double")
    return F.when(n <= FEW, n).otherwise(FEW + F.floor(F.log(n / FEW) / F.log(F.lit(RATIO)))).cast("int")


def least_shared(n, b):
    """What a set of ``n`` tokens must share with any of band ``b`` for a link."""
    start = F.when(b <= FEW, b).otherwise(F.floor(FEW * F.pow(F.lit(RATIO), b - FEW)) - 1)
    return F.ceil(NEED * (n + F.greatest(start, F.ceil(NEED * n / OF))) / (OF + NEED)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their size's band (own), one for each band (other) of sizes that a set
    of theirs may link with on this token: those of which it must share no more than what
    is left from the token on."""
    n = F.col("n")
    lo, hi = F.ceil(NEED * n / OF), F.least(F.floor(OF * n / NEED), F.floor((OF + NEED) * (n - F.col("pos")) / NEED) - n)
    return rows.withColumn("own", band(n)).filter(lo <= hi).withColumn("other", F.explode(F.sequence(band(lo), band(hi))))


def _early():
    """Whether a pair's sizes allow a link and its token is early enough in both for it."""
    need = F.ceil(NEED * (F.col("n") + F.col("x_n")) / (OF + NEED))
    return sizes_allow(F.col("n"), F.col("x_n")) & (F.col("pos") <= F.col("n") - need) & (F.col("x_pos") <= F.col("x_n") - need)


def _met(rows: DataFrame) -> DataFrame:
    """(x_doc_id, x_n, doc_id, n) of different components that share a token which, for sets
    of just these sizes, is early enough in both for a link. Bands decide where a row
    goes; the join itself asks for the two sizes, so texts that share a passage, but too
    little for a link, make no row."""
    dealt, cols = _dealt(rows), ("doc_id", "n", "pos", "component")
    x = dealt.filter("own <= other").select("token", F.col("own").alias("lo"), F.col("other").alias("hi"), *(F.col(c).alias(f"x_{c}") for c in cols))
    y = dealt.filter("own >= other").select("token", F.col("other").alias("lo"), F.col("own").alias("hi"), *cols)
    pairs = x.join(y, ["token", "lo", "hi"]).filter("component <> x_component and (lo < hi or x_doc_id < doc_id)").filter(_early())
    return pairs.select("x_doc_id", "x_n", "doc_id", "n").distinct()


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    members, found = links(docs, width)
    named = members.join(components(found).withColumnRenamed("id", "first"), "first", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
