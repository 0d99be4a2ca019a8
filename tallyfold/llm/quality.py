"""Quality classifier: Bradley-Terry scores from preference pairs.

Each text becomes a short vector of surface statistics (one pass over its bytes, its
words and its lines). A document of label 1 is preferred to one of label 0; weights
minimise the logistic loss on the feature differences of such pairs. The decision
threshold is a quantile of the training scores, and the reported score is a logistic
curve through ``cut_score`` there.

Fitting uses at most ``max_labels`` labelled documents, those with the lowest hash of
their id; scoring covers every row and every whole text.

Results on odd input: null text is the empty text, which has a score like any other, as
has a very long one, read whole; rows with a null label or id teach nothing; without both
labels every score is 0.5; of several labels of an id the least counts; repeated
rows are scored once each, rows of an empty table not at all; other columns pass through,
and a column named like the new one is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyfold.llm.common import crc_mod, lowest, slices, table

CUT_SCORE = 0.7
MAX_LABELS = 20_000
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32,), "line": (10,),
    "mark": tuple(b"!?"), "symbol": tuple(b"#$%&*@^~_=+<>\\/"), "pipe": tuple(b"|"), "stop": tuple(b".,;:"),
    "bracket": tuple(b"()[]{}\"'`-"), "control": tuple(x for x in range(32) if x not in (9, 10, 13)), "high": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = 1.0
N_FEATURES = 2 * len(_CLASSES) + 12


def features(raw: bytes) -> np.ndarray:
    n = len(raw)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(n, 1)
    toks, lines = raw.split(), raw.split(b"\n")
    m = max(len(toks), 1)
    counts, line_counts = Counter(toks), Counter(lines)
    top = counts.most_common(1)[0][1] if counts else 0
    pairs = set(zip(toks, toks[1:], toks[2:], strict=False))
    shape = [
        np.log1p(n), np.log1p(len(toks)), n / m / 10, len(counts) / m, np.log(max(len(counts), 1)) / np.log(m + 1),
        top / m, len(pairs) / max(len(toks) - 2, 1), 1 - len(line_counts) / len(lines), np.log1p(n / len(lines)),
        sum(t.isupper() for t in counts) / max(len(counts), 1), sum(not t[-1:].isalpha() and t[-1] < 128 for t in counts) / max(len(counts), 1), float(n == 0),
    ]
    return np.concatenate([share, np.sqrt(share), shape])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    @property
    def learnt(self) -> bool:
        """Whether there were rows of both labels."""
        return bool(self.weights.any())

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        at = np.clip(self.slope * (raw - self.cut), -30, 30) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-at))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 4096, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Ranker:
    """Bradley-Terry by Adam on random pairs (one document of each label)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(x.shape[1]), np.log(CUT_SCORE / (1 - CUT_SCORE)), 1.0)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(seed)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    ends = np.arange(1, max(2, 0.002 * len(raw))) / len(raw)  # single rows, where a label is very rare
    levels = np.unique(np.concatenate([np.arange(0.002, 0.999, 0.002), ends, 1 - ends]))
    cuts = np.quantile(raw, levels)
    right = [((raw >= c) == (y == 1)).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    cut = float(cuts[best[len(best) // 2]])  # the quantile in the middle of the best ones
    gap = abs(np.median(raw[good]) - np.median(raw[bad]))
    return Ranker(mean, scale, w, cut, 8.0 / max(gap, 1e-6))


def _features(texts: pa.Array) -> np.ndarray:
    got = [features(r or b"") for r in texts.cast(pa.binary()).to_pylist()]
    return np.array(got).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Ranker:
    """Learn from labelled documents; the sample is at most ``max_labels`` rows, so the
    broadcast and what comes to the driver are bounded (20,000 rows of 36 numbers)."""
    kept = lowest(labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), max_labels, "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "text"):
            yield pa.RecordBatch.from_arrays([b["quality"], pa.array(list(_features(b["text"])), pa.list_(pa.float64()))], names=["quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").orderBy("doc_id", F.xxhash64("text")).select("quality", "text")
    got = rows.mapInArrow(run, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, N_FEATURES)
    return fit_pairs(x, got["quality"].to_numpy())


def score(docs: DataFrame, model: Ranker, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, which must be new in any case."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already: give the score another name")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(_features(b["text"])))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    model = fit(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    scored = score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= CUT_SCORE, 1).otherwise(0).alias("predicted"))
