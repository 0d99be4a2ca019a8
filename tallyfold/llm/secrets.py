"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Two models of order two (each order smoothed by the one below) give a log-likelihood ratio
per character: random strings against ordinary identifiers. Both learn from labelled
samples. Random: values that the patterns find in the sampled documents, and strings drawn
from the usual alphabets. Ordinary: the words and identifiers of the same documents
outside such values, a fixed list of common words, and both joined the way identifiers
are (``like_this``, ``likeThis``, ``like/this-2``) and in capitals, and dates, versions and
numbers. Documents for this are those of lowest hash, about ``SAMPLE_DOCS`` of them, and at
most ``MAX_SAMPLES`` distinct strings of each label; everything is scanned.

A candidate is a maximal run of at least ``LEAST`` characters of keys. Its part of the
largest summed ratio, widened to the ends of its words, becomes a span of kind ``key`` if
the sum is over a threshold, which is set above the largest sum of any ordinary sample
that was held out while learning, if it holds letters, but not those of one case alone
(which are words of some language), is no UUID, and no base span overlaps it.

Results on odd input: null is the empty text, which has no spans; texts of any length are
read whole, in time that grows with their length; repeated rows and rows without an id are
scanned like any; a table without secrets or without words learns from the fixed and drawn
samples alone; ties between parts go to the first; an empty table gives no rows; other
columns pass through ``redact`` unchanged and are not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, slices, table

KINDS = ("assign", "access", "hex", "key")
Span = tuple[str, int, int]
# fixed values: the patterns of the base kinds; letters of the names in either case, A-Z only
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

LEAST, LEAST_VALUE = 16, 6
SAMPLE_DOCS, MAX_SAMPLES = 20_000, 4_000
FLOOR, MARGIN = 12.0, 1.25
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CHARS = LOWER + UPPER + DIGITS + "+/_-="
K = len(CHARS) + 1  # one more for the beginning
_code = np.full(128, K - 1, np.int64)
_code[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
_run = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_word = re.compile(r"[A-Za-z0-9+/_-]{3,}")
# fixed values: alphabets of keys, common words, and forms of numbers that are no keys
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "_-", LOWER + UPPER + DIGITS + "+/", LOWER + UPPER)
COMMON = (
    "about access account action active address after all and api app array base block body buffer build button by cache call case change char check class client close code column command comment common config connect content context control "
    "count create current data date default delete description development device document driver element enable end entry error event example export field file filter first flag font for form format from function get global group handle hash "
    "header height host html http id image import index info input insert international item key language last length level library line link list load local location lock log main manager map max message method min mode model module name "
    "network new next node number object of on open option order output page param parent password path point port position post process project property public query read record remove request reset resource response result return row run "
    "save scale schema search select send server service session set size sort source start state status string style system table target task temp test text the thread time title to token tree type update url use user util value vector version view width window with word write"
).split()
FORMS = ("####-##-##T##", "####-##-##", "##-##-####", "v#-##-#", "######", "####/##/##", "###-###-####", "#-###-#####-#", "#########", "##x##", "rc#", "sha###", "utf-#", "iso-####-#")


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; failing ones are dropped. Spans
    of keys and hexadecimal numbers lie within runs of key characters."""
    out, low = [], text.lower()
    if any(n in low for n in NAMES):
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for run in _run.finditer(text) if runs is None else runs:
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            out += [(kind, *m.span()) for m in pattern.finditer(text, *run.span())]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


# --- models --------------------------------------------------------------------------


def coded(s: str) -> np.ndarray:
    """Codes of a string after two beginnings."""
    return np.concatenate([[K - 1, K - 1], _code[np.frombuffer(s.encode("ascii"), np.uint8)]])


def markov(samples: list[str], weight: float = 8.0) -> np.ndarray:
    """log P(c | a, b) at [a, b, c]; every order is smoothed with the one below."""
    at = [coded(s) for s in samples if s]
    a, b, c = (np.concatenate([x[k : len(x) + k - 2] for x in at]) if at else np.empty(0, np.int64) for k in range(3))
    one = np.bincount(c, minlength=K) + 0.5
    p = np.broadcast_to(one / one.sum(), (K, K))
    two = np.bincount(b * K + c, minlength=K * K).reshape(K, K)
    p = (two + weight * p) / (two.sum(1, keepdims=True) + weight)
    three = np.bincount((a * K + b) * K + c, minlength=K**3).reshape(K, K, K)
    p = (three + weight * p[None]) / (three.sum(2, keepdims=True) + weight)
    return np.log(p).astype(np.float32)


def best_part(ratio: np.ndarray) -> tuple[float, int, int]:
    """The contiguous part of largest sum: the sum, its begin and end."""
    total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return float(total[end] - low[end]), int(np.argmin(total[: end + 1])), end


@dataclass
class Model:
    ratio: np.ndarray  # log-likelihood ratio of random to ordinary, by three codes
    threshold: float

    def part(self, s: str) -> tuple[float, int, int]:
        x = coded(s)
        return best_part(self.ratio[x[:-2], x[1:-1], x[2:]])


def drawn(n: int, rng: np.random.Generator) -> list[str]:
    """Random strings of the usual alphabets and lengths."""
    out = []
    for k in range(n):
        letters = ALPHABETS[k % len(ALPHABETS)]
        out.append("".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(16, 65))))
    return out


def joined(words: list[str], n: int, rng: np.random.Generator) -> list[str]:
    """Identifiers of one to five words, in the usual ways of joining them, and numbers."""
    out = []
    for k in range(n):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 6))]
        way = k % 8
        if way == 7:
            form = FORMS[int(rng.integers(len(FORMS)))]
            some.insert(int(rng.integers(len(some) + 1)), "".join(DIGITS[rng.integers(10)] if c == "#" else c for c in form))
        text = "".join(w[:1].upper() + w[1:] for w in some) if way == 0 else ("", "_", "-", "/", "_", "", "-", "-")[way].join(some)
        text = text.upper() if way in (4, 5) else text[:1].lower() + text[1:] if way == 0 and k % 16 else text
        out.append(text + (str(rng.integers(1000)) if k % 5 == 0 else ""))
    return out


def learn(random: list[str], ordinary: list[str], seed: int = 11) -> Model:
    """The models of labelled strings. Every second ordinary string is held out once for
    the threshold; the models returned have learnt from all."""
    rng = np.random.default_rng(seed)
    random = random + drawn(max(len(random), MAX_SAMPLES), rng)
    sides = []
    for k in (0, 1):
        words = ordinary[k::2] + COMMON[k::2]
        own = words + [w.upper() for w in words[::4]] + [w.capitalize() for w in words[1::4]]
        sides.append(own + joined(words, 2 * len(own), rng))
    half = Model(markov(random) - markov(sides[0]), 0.0)
    most = max(half.part(s)[0] for s in sides[1])
    return Model(markov(random) - markov(sides[0] + sides[1]), max(FLOOR, MARGIN * most))


def key_spans(text: str, model: Model, runs: list[re.Match], base: list[Span]) -> list[Span]:
    """Parts of runs that look random, clear of the base spans."""
    out, taken = [], bytearray(len(text) if base else 0)
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for run in runs:
        s = run[0]
        if UUID.fullmatch(s) or not any(c.isalpha() for c in s):
            continue
        total, a, b = model.part(s)
        if total < model.threshold:
            continue
        # to the ends of the words it begins and ends in
        while a > 0 and s[a - 1] not in "/_-+=":
            a -= 1
        while b < len(s) and (s[b] not in "/_-+=" or s[b:].strip("=") == ""):
            b += 1
        while a < b and s[a] in "/_-":
            a += 1
        lo, hi, letters = run.start() + a, run.start() + b, "".join(c for c in s[a:b] if c.isalpha())
        word = not letters or s[a:b].isalpha() and (letters[1:].islower() or letters.isupper())
        if b - a >= LEAST and not word and taken.find(1, lo, hi) < 0:
            out.append(("key", lo, hi))
    return out


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones."""
    runs = list(_run.finditer(text))
    base = base_spans(text, runs)
    return base, key_spans(text, model, runs, base) if runs else []


# --- Spark ---------------------------------------------------------------------------


def labelled(docs: DataFrame, n_docs: int = SAMPLE_DOCS, limit: int = MAX_SAMPLES) -> tuple[list[str], list[str]]:
    """Random and ordinary strings, at most ``limit`` of each, of about ``n_docs`` documents."""
    share = min(1.0, n_docs / max(1, docs.count()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            found: set[tuple[bool, str]] = set()
            for text in batch["text"].to_pylist():
                at = 0
                taken = sorted((a, b, k) for k, a, b in base_spans(text))
                for a, b, kind in [*taken, (len(text), len(text), "")]:
                    if kind:
                        value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                        found |= {(True, w) for w in _word.findall(value) if len(w) >= LEAST}
                    found |= {(False, w) for w in _word.findall(text, at, max(at, a)) if len(w) < 64 and any(c.isalpha() for c in w)}
                    at = max(at, b)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.bool_()), pa.array([w for _, w in found], pa.string())], names=["random", "value"])

    few = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("text")
    found = materialize(few.mapInArrow(run, "random boolean, value string").distinct(), "samples")
    lowest = lambda label: [r.value for r in found.filter(F.col("random") == label).orderBy(F.xxhash64("value"), "value").limit(limit).collect()]
    return lowest(True), lowest(False)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_key long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: base spans by kind and their digest, added spans, all spans."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                base, more = spans(text, model)
                rows.append((*(sum(k == kind for k, _, _ in base + more) for kind in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, FOUND)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span, or spans that overlap, as ``[SECRET]``; null stays null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, done = [], 0
        for _, a, b in sorted(sum(spans(text, model), []), key=lambda s: (s[1], -s[2])):
            if a >= done:
                parts += [text[done:a], "[SECRET]"]
            done = max(done, b)
        return "".join(parts) + text[done:]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, "text"):
            text = pa.array(list(map(clean, batch["text"].to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch[c] for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(*labelled(docs)))
