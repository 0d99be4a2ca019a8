"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top.

The tagger (numpy throughout) reads windows of characters and emits a score per tag;
the CRF adds a score per pair of neighbouring tags. It is trained on windows whose
spans are labelled by the patterns, from at most ``MAX_WINDOWS`` windows of lowest
hash, and on altered copies of them: the labelled span spelt out ("name (at) host dot
com"), written without its plus, with other or doubled separators, in brackets, or
replaced by a harmless number. So it learns forms that no pattern matches. A text is
read in overlapping windows; where windows overlap their emissions are averaged,
weighted towards each window's middle, and one Viterbi pass over the joined stretch
decides globally. Every form holds a digit, an ``@`` or a spelt-out dot, so stretches of
text further than ``REACH`` from any of these are known to be empty and are not read by
the network; the test for them sees every character.

A decoded span is widened to whole numbers and names, and is added to the pattern spans
if its mean confidence is at least ``MIN_CONFIDENCE``, it overlaps none of them and it is
``plausible``: enough digits, a right checksum, or an address once "at" and "dot" are
signs again. Keys and passwords ("token = ...") are a fifth kind beside the four: they are
redacted and reported in columns of their own.

Results on odd input: null is the empty text, which has no spans; texts of any length are
read whole, in time that grows with their length; repeated rows are scanned once each, an
empty table gives no rows; rows without an id are scanned like any; a table without
labelled windows trains nothing and adds nothing; ties between lengths of spans that begin
alike go to the longest; other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import low_hashes, materialize, slices, table

KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns of the four kinds
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # found by _addresses, in linear time
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TAGS = (*KINDS, "secret")
MAX_WINDOWS = 1200
WINDOW, STRIDE, REACH = 96, 48, 24
MIN_CONFIDENCE = 0.7
READ = 512  # windows read in step
Span = tuple[str, int, int]

_hint = re.compile(r"[0-9@]|(?<=[\s\[({<])dot(?=[\s\])}>])", re.I)
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_assigned = re.compile(r"[:=]\s{0,4}[\"']?([A-Za-z0-9+/_=.-]{16,})")
_named = re.compile(r"(?:token|secret|password|passwd|pwd|credentials?|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)[\"']?\s{0,4}$", re.I)
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(d: list[int]) -> bool:
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(odd) + sum(2 * x - 9 * (x > 4) for x in even)) % 10 == 0


def small(number: str) -> bool:
    """At most 255, however many digits it has."""
    n = number.lstrip("0")
    return len(n) < 3 or len(n) == 3 and n <= "255"


def holds(kind: str, s: str) -> bool:
    """The exact check of a whole span."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(small(x) for x in s.split("."))
    d = digits(s)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped."""
    if not _hint.search(text):
        return []
    out = []
    for kind, pattern in PATTERNS.items():
        if {"email": "@", "ip": ".", "phone": "+"}.get(kind, "") in text:
            found = _emails(text) if kind == "email" else _addresses(text) if kind == "ip" else ((m.start(), m.end()) for m in pattern.finditer(text))
            out += [(kind, a, b) for a, b in found if holds(kind, text[a:b])]
    return out


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """As the ip pattern's finditer: fours of the numbers of each dotted run."""
    for run in _dotted.finditer(text):
        if run[0].count(".") >= 3:
            at, numbers = run.start(), run[0].split(".")
            for k in range(0, len(numbers) - 3, 4):
                size = sum(map(len, numbers[k : k + 4])) + 3
                yield at, at + size
                at += size + 1


def secrets(text: str) -> list[Span]:
    """Keys and passwords: a long value of letters and digits after a name for one."""
    out = []
    if _hint.search(text):
        for m in _assigned.finditer(text):
            if _hint.search(m[1]) and not m[1].isdigit() and _named.search(text[max(0, m.start() - 24) : m.start()]):
                out.append(("secret", *m.span(1)))
    return out


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's finditer, but it looks only around each @: the local part is
    the run of its characters just before, no earlier than the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        lead = at
        while lead > done and text[lead - 1] in _local:
            lead -= 1
        m = PATTERNS["email"].match(text, lead) if lead < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (TAGS.index(s[0]), s[1])))


# --- forms the patterns do not match ------------------------------------------------

# fixed values: ways to write a span of each kind otherwise, and numbers that are no such span
AT = (" at ", " (at) ", "[at]", " [at] ", " @ ", "{at}")
DOT = (" dot ", " (dot) ", "[dot]", " [dot] ", " . ", "{dot}")
BREAKS = {"ip": ("[.]", " . ", "(.)", " dot ", ". "), "card": (".", "  ", "/", "_", " - "), "phone": ("/", ".", " ", "-", "  ")}
HARMLESS = ("####-##-##", "##.##.####", "#,###,###.##", "##:##:##", "##.#.#", "p. ###", "No. ################", "##########", "# ### ###", "at ##", "@##", "## dot ##", "(####)", "###-####", "##%")
_at = re.compile(r"\s*[\[({<]?\s*(?:\bat\b|@)\s*[\])}>]?\s*", re.I)
_dot = re.compile(r"\s*[\[({<]?\s*(?:\bdot\b|\.)\s*[\])}>]?\s*", re.I)
_tail = re.compile(rf"(?:{_dot.pattern})[A-Za-z0-9-]+", re.I)
_lead = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_at.pattern})$", re.I)
_last_word = re.compile(r"\s+\S{1,64}$")
_date = re.compile(r"[12][0-9]{3}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][12][0-9]{3}")
_breaks = re.compile(r"[^0-9A-Za-z]+")


def otherwise(kind: str, s: str, rng: np.random.Generator) -> str:
    """A span written in a form that its pattern does not match."""
    pick = lambda x: str(x[rng.integers(len(x))])
    if kind == "email":
        return s.replace("@", pick(AT)).replace(".", pick(DOT))
    if kind in BREAKS:
        out = _breaks.sub(lambda _: mark, s.lstrip("+")) if (mark := pick(BREAKS[kind])) else s
        return pick(("00", "0", "(0)", "")) + out if kind == "phone" else out
    return s


def harmless(rng: np.random.Generator) -> str:
    return "".join(str(rng.integers(10)) if c == "#" else c for c in HARMLESS[rng.integers(len(HARMLESS))])


def made_up(kind: str, rng: np.random.Generator) -> str:
    """A new span of a kind, so that every kind is seen in every surrounding."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda lo, hi: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))
    if kind == "email":
        return f"{name(2, 9)}{rng.choice(['', '.', '_', number(2)])}{name(2, 9)}@{name(3, 10)}.{name(2, 4)}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        d = number(15)
        d += next(x for x in "0123456789" if luhn(digits(d + x)))
        return str(rng.choice(["", " ", "-"])).join(d[i : i + 4] for i in range(0, 16, 4))
    return f"+{rng.integers(1, 99)} ({rng.integers(20, 999)}) {number(3)}-{number(4)}"


def altered(part: str, tags: bytes, rng: np.random.Generator) -> tuple[str, bytes]:
    """A labelled window with its spans written otherwise, made up anew or made harmless."""
    out, label, at = [], bytearray(), 0
    while at < len(part):
        end = at + 1
        while end < len(part) and tags[end] == tags[at]:
            end += 1
        piece, tag = part[at:end], tags[at]
        if tag:
            turn = rng.random()
            if turn < 0.25:
                piece, tag = harmless(rng), 0
            elif turn < 0.6:
                tag = 1 + int(rng.choice(len(KINDS), p=(0.4, 0.2, 0.2, 0.2)))
                piece = made_up(KINDS[tag - 1], rng)
            if tag and rng.random() < 0.8:
                piece = otherwise(TAGS[tag - 1], piece, rng)
        out.append(piece)
        label += bytes([tag]) * len(piece)
        at = end
    return "".join(out)[:WINDOW], bytes(label[:WINDOW].ljust(WINDOW, b"\0"))


def plausible(kind: str, s: str) -> bool:
    """The looser check of a span that the tagger adds."""
    if kind == "email":
        return bool(PATTERNS["email"].fullmatch(_dot.sub(".", _at.sub("@", s))))
    if kind == "secret":
        return len(s) >= 16 and not re.search(r"\s", s) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    if re.search(r"[^\W\d_]", _dot.sub(".", s)):
        return False
    if kind == "ip":
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and all(map(small, numbers))
    d = digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and not _date.fullmatch(s) and (s[0] in "0(+" or len(_breaks.findall(s)) > 1)


_NAME = {"email": _local, "secret": _local | frozenset("/=")}
_DIGITS = frozenset("0123456789")


def widened(text: str, kind: str, a: int, b: int, runs: dict[tuple[str, str], tuple[int, int]] | None = None) -> tuple[int, int]:
    """The span to the ends of the names and numbers it begins and ends in. ``runs``: the
    runs last walked through, so that many spans in one run cost its length once."""
    inside, runs = _NAME.get(kind, _DIGITS), {} if runs is None else runs
    while a < b and text[a] not in inside and text[a] not in "(+":
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if a < b:
        (lo, hi), at = runs.get((kind, "before"), (0, 0)), a
        while a > 0 and text[a - 1] in inside:
            a = lo if lo < a <= hi else a - 1
        runs[kind, "before"] = a, at
        (lo, hi), at = runs.get((kind, "after"), (0, 0)), b
        while b < len(text) and text[b] in inside and text[b] != ".":
            b = hi if lo <= b < hi else b + 1
        runs[kind, "after"] = at, b
    if kind == "email" and a < b:  # the rest of a spelt-out address
        while more := _tail.match(text, b):
            b = more.end()
        if before := _lead.search(text, max(0, a - 64), a):
            a = before.start()
    return (a - 1, b) if kind == "phone" and a and text[a - 1] in "+(" else (a, b)


# --- windows -------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within REACH of a digit, an @ or a spelt-out dot."""
    out: list[list[int]] = []
    for m in _hint.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(a: int, b: int) -> range:
    return range(a, max(a + 1, b - STRIDE), STRIDE)


N_CHARS = 130  # ASCII, anything else, padding


def codes(part: str) -> np.ndarray:
    raw = np.frombuffer(part.encode("utf-32-le"), np.uint32)
    out = np.full(WINDOW, N_CHARS - 1, np.int64)
    out[: len(raw)] = np.minimum(raw, N_CHARS - 2)
    return out


# --- the network ---------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: time, batch, width. States of every step, and what the way back needs, if any."""
    steps, n, size = len(x), x.shape[1], wh.shape[0]
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out, kept = np.empty((steps, n, size), x.dtype), []
    pre = x @ wx + b
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        if keep:
            kept.append((i, f, o, g, c, h))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, kept: list, states: np.ndarray, grad: np.ndarray, wx: np.ndarray, wh: np.ndarray):
    size = wh.shape[0]
    dh, dc = np.zeros_like(states[0]), np.zeros_like(states[0])
    dz = np.empty((*grad.shape[:2], 4 * size), grad.dtype)
    dwh = np.zeros_like(wh)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, c0, h0 = kept[t]
        tc = np.tanh(f * c0 + i * g)
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dwh += h0.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ wx.T, x.reshape(len(flat), -1).T @ flat, dwh, flat.sum(0)


@dataclass
class Tagger:
    """Parameters by name. ``tags``: 0 outside, then the kinds."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(width: int = 12, size: int = 16, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        k = len(TAGS) + 1
        new = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"chars": new(N_CHARS, width) * 3, "out": new(2 * size, k), "out_b": np.zeros(k, np.float32), "pair": np.zeros((k, k), np.float32)}
        for d in "fb":
            p |= {f"{d}x": new(width, 4 * size), f"{d}h": new(size, 4 * size), f"{d}c": np.zeros(4 * size, np.float32)}
        return Tagger(p)

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: batch, time of character codes. Scores: time, batch, tag."""
        p, e = self.p, self.p["chars"][x.T]
        hf, kf = _lstm(e, p["fx"], p["fh"], p["fc"], keep)
        hb, kb = _lstm(e[::-1], p["bx"], p["bh"], p["bc"], keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        out = h @ p["out"] + p["out_b"]
        return (out, (e, hf, kf, hb, kb, h)) if keep else out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` (batch, time) and its gradient."""
        p, n = self.p, len(x)
        emit, (e, hf, kf, hb, kb, h) = self.emissions(x, keep=True)
        loss, de, dpair = crf_gradient(emit, y.T, p["pair"])
        de, g = de / n, {"pair": dpair / n}
        flat = de.reshape(-1, de.shape[2])
        g |= {"out": h.reshape(len(flat), -1).T @ flat, "out_b": flat.sum(0)}
        dh, size = de @ p["out"].T, p["fh"].shape[0]
        df, g["fx"], g["fh"], g["fc"] = _lstm_back(e, kf, hf, dh[..., :size], p["fx"], p["fh"])
        db, g["bx"], g["bh"], g["bc"] = _lstm_back(e[::-1], kb, hb, dh[::-1, :, size:], p["bx"], p["bh"])
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], x.T, df + db[::-1])
        return loss / n, g


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def crf_marginals(emit: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log scores and the log partition of each sequence."""
    steps = len(emit)
    fwd, back = np.empty_like(emit), np.zeros_like(emit)
    fwd[0] = emit[0]
    for t in range(1, steps):
        fwd[t] = emit[t] + _lse(fwd[t - 1][:, :, None] + pair, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = _lse(pair + (emit[t + 1] + back[t + 1])[:, None, :], 2)
    return fwd, back, _lse(fwd[-1], 1)


def crf_gradient(emit: np.ndarray, y: np.ndarray, pair: np.ndarray):
    """Loss (summed over sequences), its gradient by emission and by tag pair."""
    steps, n, _ = emit.shape
    fwd, back, total = crf_marginals(emit, pair)
    at = np.arange(n)
    gold = sum(emit[t, at, y[t]] for t in range(steps)) + sum(pair[y[t - 1], y[t]] for t in range(1, steps))
    de = np.exp(fwd + back - total[:, None])
    dpair = np.zeros_like(pair)
    for t in range(1, steps):
        dpair += np.exp(fwd[t - 1][:, :, None] + pair + (emit[t] + back[t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(dpair, (y[t - 1], y[t]), -1)
    for t in range(steps):
        de[t, at, y[t]] -= 1
    return float((total - gold).sum()), de, dpair


def viterbi(emit: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best tag path of one sequence (time, tag)."""
    score, back = emit[0], []
    for row in emit[1:]:
        step = score[:, None] + pair
        back.append(step.argmax(0))
        score = step.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def train(x: np.ndarray, y: np.ndarray, steps: int = 360, batch: int = 96, rate: float = 0.012, seed: int = 3) -> Tagger | None:
    """Adam over shuffled mini-batches; None without any labelled span."""
    if not len(x) or not y.any():
        return None
    net, rng, t = Tagger.fresh(seed=seed), np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    while t < steps:
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, t = order[at : at + batch], t + 1
            _, g = net.gradient(x[rows], y[rows])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


# --- Spark ---------------------------------------------------------------------------


def labelled_windows(docs: DataFrame, limit: int = MAX_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a tag per character, at most ``limit`` of the table's own (those of
    lowest hash, so the sample does not depend on its order), each with a span followed by
    three altered copies."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, texts, tags = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                spans = base_spans(text) + secrets(text)
                for a, b in stretches(text):
                    for s in window_starts(a, b):
                        part = text[s : min(b, s + WINDOW)]
                        tag = bytearray(WINDOW)
                        for kind, lo, hi in spans:
                            lo, hi = max(lo - s, 0), min(hi - s, len(part))
                            if lo < hi:
                                tag[lo:hi] = bytes([1 + TAGS.index(kind)]) * (hi - lo)
                        keys.append(hashlib.md5(f"{doc}:{s}".encode()).hexdigest())
                        texts.append(part)
                        tags.append(bytes(tag))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(tags, pa.binary())], names=["key", "part", "tags"])

    # windows of a few times as many documents as are needed, those of lowest hash, so that
    # what is sorted below does not grow with the table
    hinted = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    rows = low_hashes(hinted, 4 * limit, "doc_id", "text").mapInArrow(run, "key string, part string, tags binary")
    # written first: collected directly, every task would hand the driver ``limit`` rows
    got = materialize(rows.orderBy("key", "part").limit(limit), "windows").toPandas().sort_values(["key", "part"])
    rng, rows = np.random.default_rng(7), []
    for part, tags in zip(got["part"], map(bytes, got["tags"]), strict=True):
        rows += [(part, tags), *(altered(part, tags, rng) for _ in range(3 * any(tags)))]
    x = np.array([codes(p) for p, _ in rows]).reshape(-1, WINDOW)
    y = np.array([np.frombuffer(t, np.uint8) for _, t in rows], np.int64).reshape(-1, WINDOW)
    return x, y


_WEIGHT = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)


def found_by(net: Tagger | None, texts: list[str], min_confidence: float = MIN_CONFIDENCE) -> list[list[Span]]:
    """Spans the tagger finds in each text (whether or not the patterns have them)."""
    out: list[list[Span]] = [[] for _ in texts]
    if net is None:
        return out
    plan = [(k, a, b) for k, text in enumerate(texts) if _hint.search(text) for a, b in stretches(text)]
    at = 0
    while at < len(plan):  # blocks of about READ windows bound the memory
        part, n = [], 0
        while at < len(plan) and n < READ:
            part.append(plan[at])
            n += len(window_starts(*plan[at][1:]))
            at += 1
        jobs = [(j, s) for j, (_, a, b) in enumerate(part) for s in window_starts(a, b)]
        pieces = []
        for lo in range(0, len(jobs), READ):
            some = jobs[lo : lo + READ]
            x = np.array([codes(texts[part[j][0]][s : min(part[j][2], s + WINDOW)]) for j, s in some])
            pieces.append(net.emissions(x).swapaxes(0, 1))
        emit = np.concatenate(pieces) if pieces else np.empty((0, WINDOW, len(TAGS) + 1))
        i = 0
        for k, a, b in part:
            total, weight = np.zeros((b - a, emit.shape[2]), np.float32), np.zeros((b - a, 1), np.float32)
            for s in window_starts(a, b):
                n = min(WINDOW, b - s)
                total[s - a : s - a + n] += emit[i, :n] * _WEIGHT[:n, None]
                weight[s - a : s - a + n] += _WEIGHT[:n, None]
                i += 1
            # sums over a stretch of any length: float32 would make its confidence meaningless
            joined, pair = (total / np.maximum(weight, 1e-6)).astype(np.float64), net.p["pair"].astype(np.float64)
            path = viterbi(joined, pair)
            if not path.any():
                continue
            fwd, back, whole = crf_marginals(joined[:, None], pair)
            sure = np.exp(fwd + back - whole[:, None])[:, 0]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])))
            for lo, hi in zip(edges, edges[1:], strict=False):
                tag = path[lo]
                if tag and sure[lo:hi, tag].mean() >= min_confidence:
                    out[k].append((TAGS[tag - 1], a + int(lo), a + int(hi)))
    return out


def added(text: str, known: list[Span], found: list[Span]) -> list[Span]:
    """Of the tagger's spans, those clear of the known ones and plausible."""
    taken, out, runs, tried = bytearray(len(text)), [], {}, set()
    for _, a, b in known if found else ():
        taken[a:b] = b"\1" * (b - a)
    for kind, a, b in found:
        a, b = widened(text, kind, a, b, runs)
        if (kind, a, b) in tried:
            continue
        tried.add((kind, a, b))
        for _ in range(3 if kind == "email" else 0):  # a spelt-out address may end in words too many
            if plausible(kind, text[a:b]) or not (m := _last_word.search(text, a, b)):
                break
            b = m.start()
        if a < b and taken.find(1, a, b) < 0 and plausible(kind, text[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((kind, a, b))
    return out


def _spans(net: Tagger | None, texts: list[str]) -> Iterator[tuple[list[Span], list[Span], list[Span]]]:
    """Per text: base spans, all spans of the four kinds, secrets."""
    for text, found in zip(texts, found_by(net, texts), strict=True):
        base, keys = base_spans(text), secrets(text)
        more = added(text, base + keys, found)
        yield base, base + [s for s in more if s[0] in KINDS], keys + [s for s in more if s[0] not in KINDS]


def _whole(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).alias(col)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secrets long, secrets string"


def detect(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """Per document: pattern spans by kind, their digest, all spans, their number; the
    secrets' number and spans."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            rows = []
            for base, spans, keys in _spans(net, batch["text"].to_pylist()):
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), digest(base), written(spans), len(spans), len(keys), written(keys)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", _whole()).mapInArrow(run, FOUND)


def redact(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays
    null, and ``n_chars``, if there, follows the new text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            texts = batch["text"].to_pylist()
            out = []
            for text, (_, spans, keys) in zip(texts, _spans(net, [t or "" for t in texts]), strict=True):
                spans = spans + keys
                parts, done = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b > done:  # spans of two kinds may overlap: one mark for both
                        parts += [text[done:a], f"[{kind.upper()}]"] if a >= done else []
                        done = b
                out.append(text if text is None or not spans else "".join(parts) + text[done:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch[c] for c in batch.schema.names], names=batch.schema.names)

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(*labelled_windows(docs)))
