"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

1. Seeds of an item are all its pairs of neighbouring words. In a document a pair also
   counts with one word between, so a word put in after every word hides nothing.
2. ``seeds_needed`` derives from ``min_score`` how many of them any alignment of that
   score must hit; where that is none (items of up to 3 words, or a low ``min_score``)
   the seeds are single words. If an alignment hits at least ``need`` of ``t`` seeds, it
   hits one of any ``t - need + 1``: a scan counts in how many documents each seed
   occurs, and the rarest ``t - need + 1`` of an item are its rare seeds.
3. A second scan joins documents to items by their rare seeds, checks the number of all
   seeds of the items met, and opens windows around the hits, wide enough for every
   insertion and gap the score allows; overlapping windows merge.
4. Smith-Waterman over words scores window against item, many at a time; the best
   window per (document, item) with ``score / best possible >= min_score`` stays.

No alignment of ``min_score`` is lost: the result is that of aligning all pairs.

The join's small side, the items, travels to the tasks in blocks dealt by a hash, of
about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes of text at most, two scans per
block. So what a task and the driver hold is bounded however many items a benchmark has
and however long they are (a single longer item is held whole), and no text is ever
shuffled.

Results on odd input: null or blank texts match nothing and blank items are never found; a
very long text is read whole, window by window; several texts of one item id are all
items, and items without an id are found under a null id; rows without a document id
count as one document; ties go to the first window; repeated rows give one row per
(doc_id, item_id); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import slices, table, text_bytes

MIN_SCORE = 0.5
MATCH, MISS, GAP = 2, -1, 1
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 4_000_000
HITS = "doc_id long, item_id long, score double, start_word long, n_words long"

_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def normalised(raw: bytes) -> list[bytes]:
    """The words without case and ASCII punctuation, so decoration and shouting do not
    hide a copy."""
    return raw.decode().lower().encode().translate(None, _PUNCTUATION).split()


def most_errors(m: int, min_score: float, matches: int) -> int:
    """Misses and gaps that an alignment of ``min_score`` with these matches can have."""
    return math.floor(MATCH * (matches - min_score * m) + 1e-9)


def seeds_needed(m: int, min_score: float) -> int:
    """Neighbouring item words that every alignment of ``min_score`` matches with at most
    one document word between; 0 where some alignment has none.

    ``k`` matches have ``k - 1`` steps. An error that uses up an item word spoils one
    step, and of insertions it takes two.
    """
    least = m
    for k in range(max(1, math.ceil(min_score * m - 1e-9)), m + 1):
        errors = most_errors(m, min_score, k)
        within = min(errors, m - k)
        least = min(least, k - 1 - within - (errors - within) // 2)
    return max(0, least)


class Items:
    """A block of test items: their words by number, and their seeds as (gram, item,
    offset). A word of a document that no item has is 0 and in no gram."""

    def __init__(self, ids: list[int | None], texts: list[bytes], min_score: float = MIN_SCORE):
        self.ids, self.number = ids, {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in normalised(t)], np.int64) for t in texts]
        self.need, self.slack = np.zeros(len(ids), np.int64), []
        cols: dict[bool, list] = {True: [], False: []}
        for k, h in enumerate(self.words):
            m = len(h)
            n = seeds_needed(m, min_score)
            self.need[k] = n or max(1, math.ceil(min_score * m - 1e-9))
            self.slack.append(max(0, most_errors(m, min_score, m)))
            g = self.pairs(h[:-1], h[1:]) if n else h
            cols[n > 0].append((g, np.full(len(g), k), np.arange(len(g))))
        self.seeds = {}
        for paired, parts in cols.items():
            if parts:
                grams, owner, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = np.argsort(grams, kind="stable")
                unique, first = np.unique(grams[at], return_index=True)
                self.seeds[paired] = (unique, np.append(first, len(at)), owner[at], offset[at])
        self.choose({})

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * (len(self.number) + 1) + second

    def read(self, raw: bytes) -> np.ndarray:
        toks = normalised(raw)
        return np.fromiter(map(self.number.get, toks, repeat(0)), np.int64, len(toks))

    def choose(self, counts: dict[tuple[bool, int], int]) -> None:
        """Keep as rare seeds of each item its rarest ones, as many as make a hit sure."""
        self.rare = {}
        for paired, (unique, first, owner, _) in self.seeds.items():
            seen = np.fromiter((counts.get((paired, g), 0) for g in unique.tolist()), np.int64, len(unique))
            gram = np.repeat(np.arange(len(unique)), np.diff(first))
            order = np.lexsort((gram, seen[gram], owner))
            place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            total = np.bincount(owner, minlength=len(self.ids))
            rare = np.zeros(len(order), bool)
            rare[order] = place <= (total - self.need)[owner[order]]
            self.rare[paired] = (rare, np.bincount(gram[rare], minlength=len(unique)) > 0)

    def met(self, doc: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """For pairs and single words: the seeds a document has, by their number among
        all, and where each occurrence begins."""
        there = np.flatnonzero(doc)
        if not len(there):
            return
        for paired, (unique, *_) in self.seeds.items():
            g, at = doc[there], there
            if paired:
                after = [x[doc[x + d] > 0] for d in (1, 2) for x in [there[there < len(doc) - d]]]
                at = np.concatenate(after)
                g = np.concatenate([self.pairs(doc[x], doc[x + d]) for d, x in enumerate(after, 1)])
            if len(g) and len(unique):
                place = np.minimum(np.searchsorted(unique, g), len(unique) - 1)
                hit = unique[place] == g
                yield paired, place[hit], at[hit]

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, its seed's offset and the place in the document, of all seed matches of
        the items of which the document has a rare seed, and enough seeds."""
        out = []
        for paired, gram, at in self.met(doc):
            _, first, owner, offset = self.seeds[paired]
            rare, any_rare = self.rare[paired]
            own = np.unique(gram)
            if not any_rare[own].any():
                continue
            rows, _ = _rows(first, own)
            mine = owner[rows]
            enough = np.bincount(mine, minlength=len(self.ids)) >= self.need
            enough &= np.bincount(mine[rare[rows]], minlength=len(self.ids)) > 0
            if not enough[mine].any():
                continue
            keep = np.zeros(len(first), bool)
            keep[np.repeat(own, first[own + 1] - first[own])[enough[mine]]] = True
            kept = keep[gram]
            rows, n = _rows(first, gram[kept])
            where, mine = np.repeat(at[kept], n), enough[owner[rows]]
            out.append((owner[rows[mine]], offset[rows[mine]], where[mine]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def windows(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end word) of the passages to align."""
        item, offset, where = self.hits(doc)
        out: list[tuple[int, int, int]] = []
        for k in np.unique(item):
            m, slack = len(self.words[k]), self.slack[k]
            own = item == k
            start = where[own] - offset[own]
            order = np.argsort(start, kind="stable")
            start, seed = start[order], offset[own][order]
            for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > slack) + 1):
                if len(np.unique(seed[part])) >= self.need[k]:
                    out.append((int(k), max(0, int(start[part[0]]) - slack), min(len(doc), int(start[part[-1]]) + m + slack)))
        return out


def _rows(first: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed rows of each gram, and how many it has."""
    n = first[grams + 1] - first[grams]
    ends = np.cumsum(n)
    return np.repeat(first[grams] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


def smith_waterman(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs of a batch in step.

    Rows of the table are computed for every pair at once; the gap along a row is a
    running maximum, so only the loop over item words is left to Python.
    """
    if not windows:
        return np.empty(0, np.int32)
    wide, tall = max(map(len, windows)), max(map(len, items))
    doc, item = np.zeros((len(windows), wide), np.int64), np.zeros((len(windows), tall), np.int64)
    there, need = np.zeros(doc.shape, bool), np.zeros(item.shape, bool)
    for k, (w, i) in enumerate(zip(windows, items, strict=True)):
        doc[k, : len(w)], there[k, : len(w)] = w, True
        item[k, : len(i)], need[k, : len(i)] = i, True
    ramp = GAP * np.arange(wide, dtype=np.int32)
    prev, best = np.zeros((len(windows), wide), np.int32), np.zeros(len(windows), np.int32)
    for r in range(tall):
        same = (doc == item[:, r, None]) & there & need[:, r, None]
        diag = np.zeros_like(prev)
        diag[:, 1:] = prev[:, :-1]
        t = np.maximum(np.maximum(diag + np.where(same, MATCH, MISS), prev - GAP), 0)
        prev = np.maximum.accumulate(t + ramp, axis=1) - ramp
        best = np.maximum(best, prev.max(1))
    return best


def _align(found: list[tuple], items: Items, min_score: float) -> list[tuple]:
    out = []
    found.sort(key=lambda x: x[3] - x[2])
    at = 0
    while at < len(found):
        step = max(1, 400_000 // max(1, found[min(at + 400, len(found) - 1)][3] - found[min(at + 400, len(found) - 1)][2]))
        part = found[at : at + min(step, 400)]
        best = smith_waterman([x[4] for x in part], [items.words[x[1]] for x in part])
        for (doc, k, lo, hi, _), b in zip(part, best, strict=True):
            share = float(b) / (MATCH * len(items.words[k]))
            if share >= min_score:
                out.append((doc, items.ids[k], share, lo, hi - lo))
        at += len(part)
    return out


def _read(it: Iterator[pa.RecordBatch], items: Items) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    for batch in slices(it, "raw"):
        yield [(doc, items.read(raw)) for doc, raw in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist(), strict=True)]


def seed_counts(docs: DataFrame, items: Items) -> dict[tuple[bool, int], int]:
    """In how many documents each seed of a block of items occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {paired: np.zeros(len(unique), np.int64) for paired, (unique, *_) in items.seeds.items()}
        for rows in _read(it, items):
            for _, doc in rows:
                for paired, gram, _ in items.met(doc):
                    seen[paired][np.unique(gram)] += 1
        for paired, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([paired] * len(at), pa.bool_()), pa.array(items.seeds[paired][0][at]), pa.array(n[at])], names=["paired", "gram", "n"])

    counted = docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(run, "paired boolean, gram long, n long").groupBy("paired", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most the block's own seeds
    return dict(zip(zip(got["paired"].to_pylist(), got["gram"].to_pylist(), strict=True), got["n"].to_pylist(), strict=True))


def _scan(docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _read(it, items):
            found, rows = [], []
            for doc, h in part:
                found += [(doc, k, lo, hi, h[lo:hi]) for k, lo, hi in items.windows(h)]
                if len(found) >= 4000:
                    rows += _align(found, items, min_score)
                    found = []
            rows += _align(found, items, min_score)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "start_word", "n_words"])

    return docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(run, HITS)


def find(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per (doc_id, item_id) whose passage aligns: the best score as a share of
    the highest possible, and the window's first word and length."""
    items = benchmark.select("item_id", text_bytes().alias("raw")).distinct()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ITEMS), -(-total["size"] // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == k).orderBy("item_id", "raw").collect()
        block = Items([r.item_id for r in mine], [bytes(r.raw) for r in mine], min_score)
        block.choose(seed_counts(docs, block))
        found = _scan(docs, block, min_score)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("score", "start_word", "n_words"), F.struct("score", -F.col("start_word"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
