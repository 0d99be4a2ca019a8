"""Best-fit packing: documents into sequences of bounded length, several capacities.

Tokenising is a scan without a shuffle. The pieces (ids and lengths only) are written
once to shared storage, dealt evenly into groups of about ``group_pieces`` by a hash,
and each group is packed on its own, so no task sees more than its share. A group
leaves at most a few part-filled sequences.

Results on odd input: a null text is an empty document (one end id); a very long text is
cut into as many full pieces as it has and one rest; rows without an id are packed like
any; an empty table gives no rows; repeated rows are packed once each; ties in length go
by id and piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, slices, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAX_TOKENS = 4096
BLOCK_BYTES = 6_000_000  # of text looked up at once, about 20 times that in a worker's memory
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

_pieces: dict[str, WordPieces] = {}  # of this worker, from one task to the next
_MARKS = ".,;:!?#$%&*|"
# byte-level vocabularies write the bytes that are no visible Latin-1 sign as the letters from 256 on
_UNSEEN = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x)]
_BYTE_LETTERS = {x: 256 + n for n, x in enumerate(_UNSEEN)}


def word_pieces(name: str) -> WordPieces:
    if name not in _pieces:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _pieces[name] = WordPieces(Tokenizer.from_file(public_tokenizers.path(name)))
    return _pieces[name]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each piece, one piece after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class WordPieces:
    """Token ids of many texts at once.

    White space is dropped by this vocabulary and no token crosses it, so a text's ids
    are its space-separated parts' ids in a row. The vocabulary is also blind to case
    and keeps letters apart from marks, so a part that ends in a letter and ASCII marks
    is the one, then the other. The parts of many texts are split, numbered and looked
    up as columns. Each different core goes through the library once and is remembered
    by a hash of 96 bits, at about 40 bytes a core: ``keys`` ascending, and where its ids
    are in ``flat``. Beyond ``limit`` cores only those of the last texts are kept.
    """

    def __init__(self, library: Tokenizer, limit: int = 1_000_000):
        self.library, self.limit = library, limit
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.start, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def places(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each core begin, and how many they are."""
        import xxhash

        raw = [c.encode() for c in cores]
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        checks = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
            if known.all():
                break
            todo = np.flatnonzero(~known)
            pieces = self._encoded([cores[i] for i in todo])
            if len(self.keys) + len(todo) > self.limit:
                self._keep(np.unique(at[known]))
            self._learn(keys[todo], checks[todo], pieces)
        return self.start[at], self.length[at]

    def _encoded(self, cores: list[str]) -> list[array]:
        """Ids of each core by the library. A core of Latin letters is one word to its
        normaliser and splitter, so it goes to its model at once, in byte letters."""
        model, out, rest = self.library.model, [], []
        for core in cores:
            low = core.lower()
            if low.isalpha() and max(low) < "\u0250":
                out.append(array("I", [t.id for t in model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS))]))
            else:
                rest.append(len(out))
                out.append(core)
        for k in range(0, len(rest), 10_000):
            some = rest[k : k + 10_000]
            for i, got in zip(some, self.library.encode_batch([out[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = array("I", got.ids)
        return out

    def _keep(self, at: np.ndarray) -> None:
        self.flat = self.flat[spread(self.start[at], self.length[at])]
        self.keys, self.checks, self.length = self.keys[at], self.checks[at], self.length[at]
        self.start = np.cumsum(self.length) - self.length

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[array]) -> None:
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(pieces), np.uint32)])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.checks, self.start, self.length = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.checks, checks), (self.start, start), (self.length, length)))

    def __call__(self, texts: pa.Array, words: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some texts at a time, in order: all their ids in a row, and where each text's
        begin (one place more at the end). ``texts``: strings without nulls."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        parts, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del split
        whole = parts.dictionary
        cut_ = pc.extract_regex(whole, rf"^(?P<bare>.*?)(?P<marks>[{_MARKS}]*)$")
        bare, marks = pc.struct_field(cut_, "bare"), pc.struct_field(cut_, "marks")
        # lower case of the dotted capital I ends in a mark
        apart = pc.and_not(pc.match_substring_regex(bare, r"\pL$"), pc.ends_with(bare, "İ"))
        core = pc.if_else(apart, bare, whole).dictionary_encode()
        marks = pc.if_else(apart, marks, "").dictionary_encode()
        both = self.places([*core.dictionary.to_pylist(), *marks.dictionary.to_pylist()])
        (begin, begin2), (m, m2) = (np.split(x, [len(core.dictionary)]) for x in both)
        # a part's ids: its core's, then its marks'
        begin, m, begin2, m2 = begin[i := core.indices.to_numpy()], m[i], begin2[j := marks.indices.to_numpy()], m2[j]
        length = m + m2
        start, flat = np.cumsum(length) - length, np.empty(length.sum(), np.uint32)
        flat[spread(start, m)] = self.flat[spread(begin, m)]
        flat[spread(start + m, m2)] = self.flat[spread(begin2, m2)]
        codes = parts.indices.to_numpy()
        del core, parts, begin, begin2
        first = 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + words, "right")) - 1)
            some = codes[offsets[first] : offsets[last]]
            n = length[some]
            ends = np.concatenate([[0], np.cumsum(n)])
            yield flat[spread(start[some], n)], ends[offsets[first : last + 1] - offsets[first]]
            first = last


def together(it: Iterator[pa.RecordBatch], least: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least that many bytes: words that repeat are looked up once."""
    some: list[pa.RecordBatch] = []
    for batch in it:
        some.append(batch)
        if sum(b.nbytes for b in some) >= least:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def cut(docs: DataFrame, name: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces: ids and the end id, cut only where longer than a sequence."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_pieces(name)
        for batch in slices(together(it), "text", BLOCK_BYTES):
            ids_of, at = batch["doc_id"].to_pylist(), 0
            for flat, edges in encode(batch["text"]):
                rows = []
                for doc, lo, hi in zip(ids_of[at : at + len(edges) - 1], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    ids = flat[lo:hi].tobytes() + end
                    for k, begin in enumerate(range(0, len(ids), 4 * max_tokens)):
                        part = ids[begin : begin + 4 * max_tokens]
                        rows.append((doc, k, begin // 4, len(part) // 4, zlib.crc32(part)))
                at += len(edges) - 1
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each item; items must come longest first.

    An item's demand is (tokens, 1 document, tokens squared); a bin takes it only if all
    three residual capacities allow. Among such bins ``rule`` picks: "norm" the least
    weighted norm of what would be left, "dot" the largest weighted dot product of
    demand and residual. Ties go to the oldest bin. An item that fits no empty bin gets
    one of its own.
    """
    scale = np.sqrt(np.array(weights)) / np.array([max_tokens, max_docs, max_cost])
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) * scale
    left = np.empty((256, 3))
    ids = np.empty(256, np.int64)
    full = np.array([max_tokens, max_docs, max_cost]) * scale
    out, bins, n = np.empty(len(lengths), np.int64), 0, 0
    least = demand.min(0) if len(lengths) else full
    for i, d in enumerate(demand):
        rest = left[:n] - d
        fits = (rest >= -1e-12).all(1)
        if fits.any():
            value = np.einsum("ij,ij->i", rest, rest) if rule == "norm" else -(left[:n] @ d)
            value[~fits] = np.inf
            k = int(value.argmin())
            left[k] -= d
            out[i] = ids[k]
        else:
            if n == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            k, left[n], ids[n] = n, full - d, bins
            out[i] = bins
            bins += 1
            n += 1
        if (left[k] < least - 1e-12).any():  # nothing fits any more
            left[k : n - 1], ids[k : n - 1] = left[k + 1 : n].copy(), ids[k + 1 : n].copy()
            n -= 1
    return out


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_docs: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group_pieces: int = 20_000,
) -> DataFrame:
    """Sequence and offset of each piece. ``max_docs`` and ``max_cost`` (sum of squared
    piece lengths, as attention costs) default to values that never bind."""
    docs_cap, cost_cap = max_docs or max_tokens, max_cost or float(max_tokens) ** 2
    # dealt by a number of the row: equal ids or repeated rows do not meet in one group
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32"))])
        length = rows["length"].to_numpy()
        bins = best_fit(length, max_tokens, docs_cap, cost_cap, weights, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty_like(ends)
        offset[order] = ends - length[order] - (ends - length[order])[first]
        group = rows["grp"][0].as_py() * 2**32
        return rows.drop_columns("grp").append_column("sequence_id", pa.array(bins + group)).append_column("offset", pa.array(offset))

    grp = F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("grp")
    return pieces.select(*pieces.columns[:-1], grp).groupBy("grp").applyInArrow(run, PACKED)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(table(spark, sf_dir, "documents")))
