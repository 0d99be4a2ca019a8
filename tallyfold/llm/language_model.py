"""LM scoring: a gated recurrent language model with a class-factored softmax.

Corpus counts. One scan counts every token of every training text (partial counts per
task, then one shuffle by word). The counts table stays in Spark; only its
``TOP_WORDS`` most frequent rows and a few totals go to the tasks.

Vocabulary. The most frequent ``CLASSES * PER_CLASS`` words have vectors of their own,
in classes of ``PER_CLASS`` by frequency. Every other word, known or not, is in one more
class, whose members are ``RARE_CLASSES`` endings; within its ending a word has its
smoothed share of the counts. So ``P(word) = P(class | state) * P(member | class, state)``,
two small softmaxes, and the share for rare words. Logits start at the log counts: an
untrained model is the smoothed unigram model.

Training. GRU weights learn by truncated backpropagation (numpy, ``STEPS`` tokens back,
the state carried on). In each of ``ROUNDS`` rounds every partition trains from the
common weights on all its training texts and the weights are averaged in proportion to
the tokens, in Spark, block by block and in two steps, so that no task meets more than
about ``FAN_IN`` vectors. A round covers every training text at every size.

Texts are split into words and numbered once, and written as 16-bit ids; the rounds and
the scores read these. Scoring reads whole texts; the state is carried across windows.
Counts of words beyond ``TOP_WORDS`` are found by one join.

Results on odd input: a null text is the empty text (its only token is the end); a very
long one is read whole; rows without an id count as training rows; repeated rows are
scored once each; ties in frequency go by the word; without training tokens every text
gets the uniform smoothed score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import crc_mod, materialize, most_frequent, slices, table, text_bytes, words  # noqa: F401 words: the plain form of tokens

CLASSES, PER_CLASS, RARE_CLASSES = 48, 64, 96
TOP_WORDS = 65_536
SIZE = 24
STEPS, STREAMS = 20, 256
ROUNDS = 3
FAN_IN = 1024
FLUSH = 300_000
CACHED = 512  # rows of a product
ROWS = 8192  # predictions worked out at once
IDS_BYTES = 1_200_000  # of a training step's texts
END = b"\n"  # no word can hold it
HALF = 0.5


def tokens(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``common.words`` of each text, one after the other, and how many each text has."""
    wide = pa.types.is_large_binary(raw.type)
    text = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(raw), raw.buffers(), offset=raw.offset)  # bytes are not checked
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    there = pc.not_equal(pc.binary_length(flat), 0)  # none at a text's ends
    upto = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
    return flat.filter(there).view(pa.large_binary() if wide else pa.binary()), np.diff(upto[ends - ends[0]])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, the end token included."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return b

        for batch in slices(it, "raw"):
            got = pc.value_counts(tokens(batch["raw"])[0])
            for w, n in zip(got.field(0).to_pylist(), got.field(1).to_pylist(), strict=True):
                seen[w] += n
            seen[END] += batch.num_rows
            if len(seen) > FLUSH:
                yield out()
        if seen:
            yield out()

    parts = docs.select(text_bytes().alias("raw")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def ending_class(word: bytes) -> int:
    """Member of the rare class that a word is: by its last two bytes."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7) % RARE_CLASSES


def _ending_class_sql() -> str:
    last, before = "conv(hex(substring(word, -1, 1)), 16, 10)", "conv(hex(substring(word, -2, 1)), 16, 10)"
    return f"cast((cast({last} as int) * 31 + if(length(word) > 1, cast({before} as int), 0) * 7) % {RARE_CLASSES} as int)"


@dataclass
class Vocabulary:
    """Totals of the corpus and its most frequent words."""

    tokens: int
    distinct: int
    top: dict[bytes, int]  # counts of the TOP_WORDS most frequent words, and of the end
    index: dict[bytes, int]  # the frequent words' numbers, by frequency
    rare_mass: np.ndarray  # by ending: sum of (count + 1/2), and 1/2 for the unseen

    @property
    def base_norm(self) -> float:
        return math.log10(self.tokens + HALF * (self.distinct + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    best = most_frequent(counts, TOP_WORDS).toPandas().sort_values(["n", "word"], ascending=[False, True])
    names, n = [bytes(w) for w in best["word"]], best["n"].tolist()
    frequent = [w for w in names if w != END][: CLASSES * PER_CLASS - 1]
    index = {w: k for k, w in enumerate([END, *frequent])}
    by_class = counts.groupBy(F.expr(_ending_class_sql()).alias("c")).agg(F.sum(F.col("n") + HALF).alias("m")).toPandas()
    mass = np.full(RARE_CLASSES, HALF)
    mass[by_class["c"].to_numpy(int)] += by_class["m"].to_numpy(float)
    top = dict(zip(names, n, strict=True))
    if END not in top:
        top[END] = int(counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    for w in index:
        if top[w]:
            mass[ending_class(w)] -= top[w] + HALF
    return Vocabulary(int(total[0]), int(total[1]), top, index, np.maximum(mass, HALF))


# --- the network ---------------------------------------------------------------------

WORDS = CLASSES * PER_CLASS
START = WORDS + RARE_CLASSES  # input before the first token
SHAPES = {"x": (START + 1, SIZE), "xw": (SIZE, 3 * SIZE), "hw": (SIZE, 3 * SIZE), "b": (3 * SIZE,), "cls": (SIZE, CLASSES + 1), "cls_b": (CLASSES + 1,), "word": (CLASSES, SIZE, PER_CLASS), "word_b": (CLASSES, PER_CLASS), "rare": (SIZE, RARE_CLASSES), "rare_b": (RARE_CLASSES,)}


def fresh(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(size=s) / math.sqrt(SIZE)).astype(np.float32) for k, s in SHAPES.items()}
    p["b"] *= 0
    p["cls"] *= 0
    p["word"] *= 0
    p["rare"] *= 0
    mass = np.full(WORDS, 1e-9)  # numbers without a word
    for w, k in v.index.items():
        mass[k] = v.top.get(w, 0) + HALF
    by_class = mass.reshape(CLASSES, PER_CLASS)
    masses = np.append(by_class.sum(1), v.rare_mass.sum())
    p["word_b"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    p["cls_b"] = np.log(masses / masses.sum()).astype(np.float32)
    p["rare_b"] = np.log(v.rare_mass / v.rare_mass.sum()).astype(np.float32)
    return p


def gates(w: np.ndarray) -> np.ndarray:
    """Weights of the gates z, r and the new state, one after the other: (3, SIZE, SIZE).
    Each gate is then a contiguous array. Those of z and r are halved, see ``step``."""
    out = w.reshape(-1, 3, SIZE).swapaxes(0, 1).copy()
    out[:2] *= 0.5
    return out


def blocks(first: int, end: int) -> list[slice]:
    """Rows in parts that stay in a core's cache, where products of narrow matrices are quickest."""
    return [slice(a, min(a + CACHED, end)) for a in range(first, end, CACHED)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, summed block by block."""
    return sum((a[some].T @ b[some] for some in blocks(0, len(a))), np.zeros((a.shape[1], b.shape[1]), b.dtype))


def classes_of(ids: np.ndarray) -> np.ndarray:
    return np.minimum(ids // PER_CLASS, CLASSES).astype(np.uint8)


def own_of(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Numbers of the words within their class."""
    return ids - cls.astype(np.int64) * PER_CLASS


def by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in the order of their class, and (class, first, end) of each that occurs."""
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(CLASSES + 2)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def step(pre: np.ndarray, h: np.ndarray, hw: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
    """One GRU step from the input's projection, which becomes the gates z, r and the new
    state; ``u``: what the state gives to them. sigmoid(x) is (1 + tanh(x / 2)) / 2."""
    np.matmul(h, hw, out=u)
    zr, new = pre[:2], pre[2]
    zr += u[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    new += zr[1] * u[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= zr[0]
    out += new


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row and their sum, unnormalised. Logits are small here (weights
    of a bounded state, biases at most about 0), so the plain sum is tried first."""
    ones = np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(x)
        total = e @ ones
    if not (np.isfinite(total).all() and total.all()):
        e = np.exp(x - x.max(1, keepdims=True))
        total = e @ ones
    return e, total


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their bias as one more row, for states with one more column of ones."""
    return np.concatenate([w, b[..., None, :]], -2)


def member_logits(flat: np.ndarray, parts: list[tuple[int, int, int]], p: dict[str, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows of frequent words, their logits, and those of the rare ones, which
    are last; ``flat``: states in the order of their class, and ones."""
    n = parts[-1][1] if parts and parts[-1][0] == CLASSES else len(flat)
    weights, x = with_bias(p["word"], p["word_b"]), np.empty((n, PER_CLASS), flat.dtype)
    for k, a, b in parts:
        if k < CLASSES:
            np.matmul(flat[a:b], weights[k], out=x[a:b])
    return n, x, flat[n:] @ with_bias(p["rare"], p["rare_b"])


def log_norm(x: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of each row."""
    ones = np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = np.log(np.exp(x) @ ones)
    if not np.isfinite(out).all():
        m = x.max(1)
        out = m + np.log(np.exp(x - m[:, None]) @ ones)
    return out


def log_probs(h: np.ndarray, ids: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log of P(class) * P(member | class)."""
    cls = classes_of(ids)
    order, parts = by_class(cls)
    flat = np.ones((len(ids), SIZE + 1), h.dtype)
    flat[:, :SIZE] = h[order]
    cls, own, at = cls[order], own_of(ids[order], cls[order]), np.arange(len(ids))
    x = flat @ with_bias(p["cls"], p["cls_b"])
    got = x[at, cls] - log_norm(x)
    n, x, rare = member_logits(flat, parts, p)
    got[:n] += x[at[:n], own[:n]] - log_norm(x)
    got[n:] += rare[at[: len(at) - n], own[n:]] - log_norm(rare)
    out = np.empty(len(ids))
    out[order] = got
    return out


def text_log_probs(texts: list[np.ndarray], p: dict[str, np.ndarray], group: int = 2048, window: int = 32) -> np.ndarray:
    """Summed log probability of each id sequence, the state carried across windows.
    Texts of like length run in step; those that end leave the group."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    table_, hw = p["x"] @ gates(p["xw"]) + gates(p["b"]), gates(p["hw"])
    for g in range(0, len(order), group):
        part = order[g : g + group]
        lens = np.array([len(texts[k]) for k in part])
        h, last = np.zeros((len(part), SIZE), np.float32), np.full(len(part), START)
        at = 0
        while (live := int((lens > at).sum())) > 0:
            wide = int(min(window * max(1, 64 // live), lens[0] - at))
            ids = np.zeros((live, wide), np.int64)
            for r in range(live):
                piece = texts[part[r]][at : at + wide]
                ids[r, : len(piece)] = piece
            h, last = h[:live], last[:live]
            states = np.empty((wide, live, SIZE), np.float32)
            u = np.empty((3, live, SIZE), np.float32)
            for t in range(wide):
                step(np.take(table_, last, axis=1), h, hw, u, states[t])  # has read the tokens before t
                h, last = states[t], ids[:, t]
            there = (np.arange(at, at + wide)[:, None] < lens[None, :live]).ravel()
            rows = np.flatnonzero(there)
            flat, y = states.reshape(-1, SIZE), ids.T.ravel()
            for lo in range(0, len(rows), ROWS):
                some = rows[lo : lo + ROWS]
                out[part[:live]] += np.bincount(some % live, weights=log_probs(flat[some], y[some], p), minlength=live)
            at += wide
    return out


def gradient(ids: np.ndarray, prev: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]):
    """Mean loss of a window (time, streams), its gradient, and the last state. A stream
    whose previous token is START begins a text: its state is cleared there."""
    (steps, n), total, kind = ids.shape, ids.size, p["hw"].dtype
    xw, hw, prev_ = gates(p["xw"]), gates(p["hw"]), prev.ravel()
    x = p["x"][prev_]
    g_ = x @ xw  # projections, then the gates
    g_ += gates(p["b"])
    g_ = g_.reshape(3, steps, n, SIZE)
    before, states, given = (np.empty((steps, n, SIZE), kind) for _ in range(3))
    u, begins = np.empty((3, n, SIZE), kind), [np.flatnonzero(row == START) for row in prev]
    for t in range(steps):
        before[t] = h
        before[t, begins[t]] = 0
        h = states[t]
        step(g_[:, t], before[t], hw, u, h)
        given[t] = u[2]

    y = ids.ravel()
    cls = classes_of(y)
    order, parts = by_class(cls)
    flat, at = np.ones((total, SIZE + 1), kind), np.arange(total)
    flat[:, :SIZE] = states.reshape(-1, SIZE)[order]
    cls, own, loss = cls[order], own_of(y[order], cls[order]), 0.0

    def surprise(logits: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Adds to the loss; its gradient by the logits."""
        nonlocal loss
        d, norm = softmax(logits)
        rows = at[: len(mine)]
        got = d[rows, mine] / norm
        loss -= np.log(got).sum()
        d *= (1 / (total * norm))[:, None]
        d[rows, mine] = (got - 1) / total
        return d

    weights, dsorted, gc = with_bias(p["cls"], p["cls_b"]), np.empty((total, SIZE), kind), 0
    for some in blocks(0, total):
        d = surprise(flat[some] @ weights, cls[some])
        np.matmul(d, p["cls"].T, out=dsorted[some])
        gc = gc + flat[some].T @ d
    frequent, logits, rare = member_logits(flat, parts, p)
    d, gw = surprise(logits, own[:frequent]), np.zeros((CLASSES, SIZE + 1, PER_CLASS), kind)
    for k, a, b in parts:
        if k < CLASSES:
            for some in blocks(a, b):
                gw[k] += flat[some].T @ d[some]
            dsorted[a:b] += d[a:b] @ p["word"][k].T
    d = surprise(rare, own[frequent:])
    gr = product(flat[frequent:], d)
    dsorted[frequent:] += d @ p["rare"].T
    g = {"cls": gc[:-1], "cls_b": gc[-1], "word": gw[:, :-1], "word_b": gw[:, -1], "rare": gr[:-1], "rare_b": gr[-1]}

    dout = np.empty_like(dsorted)
    dout[order] = dsorted
    dout, dh = dout.reshape(states.shape), np.zeros((n, SIZE), kind)
    z, r, m = g_
    keep = 1 - z
    by_z = np.subtract(before, m)
    by_z *= z
    by_z *= keep
    by_m = np.multiply(m, m, out=m)
    np.subtract(1, by_m, out=by_m)
    by_m *= keep
    by_r = np.multiply(given, r, out=given)
    by_r *= np.subtract(1, r, out=keep)
    du, dm, back = np.empty((3, steps, n, SIZE), kind), np.empty((steps, n, SIZE), kind), gates(p["hw"]).swapaxes(1, 2).copy()
    back[:2] *= 2  # not halved
    for t in range(steps - 1, -1, -1):
        dh += dout[t]
        np.multiply(dh, by_z[t], out=du[0, t])
        np.multiply(dh, by_m[t], out=dm[t])
        np.multiply(dm[t], by_r[t], out=du[1, t])
        np.multiply(dm[t], r[t], out=du[2, t])
        np.matmul(du[:, t], back, out=u)
        dh *= z[t]
        dh += u[0]
        dh += u[1]
        dh += u[2]
        dh[begins[t]] = 0
    rows = np.empty((total, 3 * SIZE), kind)
    for k, a in enumerate(du):
        rows[:, k * SIZE : (k + 1) * SIZE] = a.reshape(total, SIZE)
    g["hw"] = product(before.reshape(total, SIZE), rows)
    rows[:, 2 * SIZE :] = dm.reshape(total, SIZE)
    g["b"], g["xw"], dx = np.ones(total, kind) @ rows, product(x, rows), rows @ p["xw"].T
    cells = prev_[:, None].astype(np.int64) * SIZE + np.arange(SIZE)
    g["x"] = np.bincount(cells.ravel(), dx.ravel(), p["x"].size).astype(kind).reshape(p["x"].shape)
    return loss / total, g, h


class Trainer:
    """Truncated backpropagation over parallel streams of texts, by Adam."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.flat, self.rate, self.t, self.tokens = flatten(p), rate, 0, 0
        self.p = unflatten(self.flat)  # views
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rest = np.empty(0, np.int64), np.empty(0, np.int64)

    def read(self, texts: list[np.ndarray], last: bool = True) -> None:
        """One pass over some texts, dealt to the streams end to end. What does not fill
        all streams waits for the next texts, or is read by fewer if these are the last."""
        ids = [self.rest[0], *texts]
        prev = [self.rest[1], *(np.append(START, t[:-1]) for t in texts)]
        ids, prev = np.concatenate(ids), np.concatenate(prev)
        while len(ids) >= (1 if last else STREAMS * STEPS):
            streams = max(1, min(STREAMS, len(ids) // STEPS))
            n = len(ids) // streams
            x, y = (a[: n * streams].reshape(streams, n).T for a in (ids, prev))
            h = np.zeros((streams, SIZE), np.float32)
            for at in range(0, n, STEPS):
                _, g, h = gradient(x[at : at + STEPS], y[at : at + STEPS], h, self.p)
                self.update(g)
            self.tokens += n * streams
            ids, prev = ids[n * streams :], prev[n * streams :]
        self.rest = ids, prev

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        g_ = flatten(g)
        norm = math.sqrt(float(g_ @ g_))
        rate = self.rate * math.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t)
        g_ *= min(1.0, 1.0 / (norm + 1e-9))
        for at in range(0, len(g_), BLOCK):  # stays in the cache
            a, m, v, p = (x[at : at + BLOCK] for x in (g_, self.m, self.v, self.flat))
            m += np.float32(0.1) * (a - m)
            a *= a
            a -= v
            a *= np.float32(0.02)
            v += a
            np.sqrt(v, out=a)
            a += np.float32(1e-6)
            np.divide(m, a, out=a)
            a *= np.float32(rate)
            p -= a


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


def unflatten(x: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters by name: views."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


BLOCK = 8192


def token_ids(toks: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    get = index.get
    out = [get(t) for t in toks]
    out = [k if k is not None else WORDS + ending_class(t) for k, t in zip(out, toks, strict=True)]
    out.append(0)  # the end
    return np.array(out, dtype=np.int64)


ENCODED = "uid long, doc_id long, ids binary, n_known long, base double, share double, far array<binary>"


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each text as 16-bit ids with the end, so that no later step splits it again; of its
    words within the top their number, the summed log10 of (count + 1/2) and the rare ones'
    log10 share of their ending; the words beyond the top, whose counts a join finds."""
    top, index = v.top, v.index
    rare_norm = np.log10(v.rare_mass)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {w: k for k, w in enumerate(top)}
        logs = np.log10(np.array([*top.values()], float) + HALF)
        number = np.array([index[w] if w in index else WORDS + ending_class(w) for w in top])
        end = rank[END]
        for batch in slices(it, "raw"):
            n = batch.num_rows
            flat, lens = tokens(batch["raw"])
            coded = flat.dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            # by distinct word
            at = np.fromiter(map(rank.get, names, repeat(-1)), np.int64, len(names))
            inside = at >= 0
            ids = np.empty(len(names), np.int64)
            ids[inside] = number[at[inside]]
            ids[~inside] = [WORDS + ending_class(names[i]) for i in np.flatnonzero(~inside).tolist()]
            log = np.zeros(len(names))
            log[inside] = logs[at[inside]]
            rare = ids >= WORDS
            share = np.where(rare, log, 0)
            share[rare] -= rare_norm[ids[rare] - WORDS]
            # by text
            doc, beyond = np.repeat(np.arange(n), lens), ~inside[which]
            upto = np.append(0, np.cumsum(lens))
            raw = np.insert(ids[which], upto[1:], 0).astype(np.uint16).tobytes()
            cuts = 2 * (upto + np.arange(n + 1))
            far = np.bincount(doc[beyond], minlength=n)
            words_ = flat.filter(pa.array(beyond)).cast(pa.binary())
            cols = [
                batch["uid"], batch["doc_id"],
                pa.array([raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.binary()),
                pa.array(lens - far + (top[END] > 0), pa.int64()), pa.array(np.bincount(doc, log[which], n) + logs[end], pa.float64()), pa.array(np.bincount(doc, share[which], n), pa.float64()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(far)), pa.int32()), words_),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ENCODED.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_bytes().alias("raw")).mapInArrow(run, ENCODED)


def id_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch["ids"].to_pylist()]


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after rounds over the texts of ``docs``."""
    return learn(encode(docs, v), v, rounds)


def learn(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local training and weighted averaging, starting at the unigram model."""
    p = fresh(v)
    if not v.tokens:
        return p
    for k in range(rounds):
        flat, rate = flatten(p), 0.012 / (1 + k)

        def run(it: Iterator[pa.RecordBatch], flat=flat, rate=rate) -> Iterator[pa.RecordBatch]:
            net = Trainer(unflatten(flat), rate)
            for batch in slices(it, "ids", IDS_BYTES):
                net.read(id_arrays(batch), last=False)
            net.read([])
            if net.tokens:
                x = flatten(net.p)
                parts = [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
                lot = TaskContext.get().partitionId() % FAN_IN
                yield pa.RecordBatch.from_arrays([pa.array([lot] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([float(net.tokens)] * len(parts)), pa.array(parts, pa.binary())], names=["lot", "block", "weight", "part"])

        def mean(rows: pa.Table) -> pa.Table:
            w = rows["weight"].to_numpy()
            total = sum(np.frombuffer(x, np.float32) * a for x, a in zip(rows["part"].to_pylist(), w, strict=True))
            return pa.table({"lot": rows["lot"][:1], "block": rows["block"][:1], "weight": [float(w.sum())], "part": pa.array([(total / w.sum()).astype(np.float32).tobytes()], pa.binary())})

        schema = "lot int, block int, weight double, part binary"
        mine = encoded.select("ids").mapInArrow(run, schema)
        got = mine.groupBy("lot", "block").applyInArrow(mean, schema).groupBy("block").applyInArrow(mean, schema).toPandas().sort_values("block")
        if len(got):
            p = unflatten(np.concatenate([np.frombuffer(bytes(x), np.float32) for x in got["part"]]))
    return p


# --- scoring -------------------------------------------------------------------------


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return score_encoded(materialize(encode(docs, v), "encoded"), counts, v, p)


def score_encoded(encoded: DataFrame, counts: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """The same from the written rows of ``encode``."""
    flat = flatten(p)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unflatten(flat)
        for batch in slices(it, "ids", IDS_BYTES):
            ids = id_arrays(batch)
            lp = text_log_probs(ids, net) / math.log(10)
            cols = [batch["uid"], batch["doc_id"], pa.array([len(x) for x in ids], pa.int64()), batch["n_known"], batch["base"], pa.array(lp + batch["share"].to_numpy())]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "n_tokens", "n_known", "base", "model"])

    schema = "uid long, doc_id long, n_tokens long, n_known long, base double, model double"
    heads = materialize(encoded.select("uid", "doc_id", "ids", "n_known", "base", "share").mapInArrow(run, schema), "scores")
    far = encoded.select("uid", F.explode("far").alias("word")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    far = far.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + HALF)).alias("far"), F.count(F.when(F.col("c") > 0, 1)).alias("far_known"))
    heads = heads.join(far, "uid", "left").na.fill({"far": 0.0, "far_known": 0})
    return heads.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("far_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("far") - F.col("n_tokens") * F.lit(v.base_norm)).alias("base_score"), (F.col("model") + F.col("far")).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    counts = materialize(count_words(docs.filter(~held_out)), "counts")
    v = vocabulary(counts)
    encoded = materialize(encode(docs, v), "encoded")
    scored = score_encoded(encoded, counts, v, learn(encoded.filter(~held_out), v))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
