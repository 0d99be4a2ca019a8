"""What the operators of this subpackage share: table reading, scratch tables, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 2000, 2**21


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of this size at most, unless the session asks for
    smaller ones: both sides hold whole batches, outside the heap. The JVM's buffers double
    as they fill; up to 4 MB they come from its pool and are used again, larger ones are
    taken from the machine one by one, and what is freed of them need not go back to it."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # only on one machine is a local folder seen by every task
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage ends there, so a
    lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, limit: int, col: str = "n") -> DataFrame:
    """At most ``limit`` rows, those of the largest counts (positive), whole count bands
    at a time. The band comes from a histogram of at most a few hundred rows, so no task
    and not the driver ever sorts or holds more than the result."""
    band = F.floor(F.log2(col) * 16).cast("int")
    sizes = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    total, least = 0, None
    for r in sizes:
        if total + r["count"] > limit:
            break
        total, least = total + r["count"], r["band"]
    return counts.filter(band >= least) if least is not None else counts.limit(0)


def low_hashes(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """The rows whose hash of the columns ``by`` is below a threshold, which is set by the
    table's count so that about twice ``least`` rows pass, wherever they are; a table of
    up to four times ``least`` as it is."""
    n = rows.count()
    return rows.filter(F.xxhash64(*by) < int(2**64 * (2 * least + 200) / n) - 2**63) if n > 4 * least + 400 else rows


def lowest(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """The ``limit`` rows of lowest hash of the columns ``by``, ties by these. What the
    tasks hand on to be sorted is about twice the limit in all, not the limit each."""
    return low_hashes(rows, limit, *by).orderBy(F.xxhash64(*by), *by).limit(limit)


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def words(raw: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` over the text with A-Z lower-cased; both bytes methods
    are ASCII-only, which is what the definition asks for."""
    return raw.lower().split()


MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, element by element on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def slices(it: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of a text column (one text more at
    most), so that what a task makes of them at once is bounded. When the task is done
    its free memory goes back to the machine: the worker waits for other stages' tasks."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Free memory of this worker, back to the machine (where its C library can)."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class WordHasher(dict):
    """64-bit hash of each word, remembered for repeated words; the memory is bounded and
    lasts as long as the task that made it."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.limit:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def __call__(self, toks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, toks), np.uint64, len(toks))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashed ``n``-word shingles, ascending. A shorter, non-empty sequence is
    one shingle; an empty one has none."""
    if len(hashes) == 0:
        return hashes
    width = min(n, len(hashes))
    return np.unique(ngrams(hashes, width))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, in order (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(n):
        total += hashes[i : i + m] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    return mix64(total)


def batches(it: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    block = []
    for x in it:
        block.append(x)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
