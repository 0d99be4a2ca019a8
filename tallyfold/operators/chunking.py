"""Documents to sections, turns and chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_sections(docs: DataFrame, separator: str = r"\f|\n{3,}", least: int = 50, kinds: dict[str, str] | None = None) -> DataFrame:
    """J1. Parts between separators, at least ``least`` characters, typed by the first
    pattern that matches their first 500 characters."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("position", "content")).withColumn("content", F.trim("content")).filter(F.length("content") >= least)
    kind = F.lit("other")
    for name, pattern in reversed((kinds or {}).items()):
        kind = F.when(F.lower(F.substring("content", 1, 500)).rlike(pattern), name).otherwise(kind)
    return parts.withColumn("section_type", kind)


def char_windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """J2. Windows of ``size`` characters that end at the last sentence or line end past
    60 % if there is one, starting ``overlap`` before the last end; more than 50 kept."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max(text.rfind(". ", at, end) + 1, text.rfind("\n", at, end))
            if cut > at + 0.6 * size:
                end = cut
        part = text[at:end].strip()
        if len(part) > 50:
            out.append((at, part))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_chars(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """J2 over a table of texts, in Arrow batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(d, k, a, p) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for k, (a, p) in enumerate(char_windows(t or "", size, overlap))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "chunk_index", "start", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, start long, content string")


def chunk_words(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """J3. Word windows; a window that only repeats the overlap is left out."""
    step = size - overlap
    w = docs.select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - overlap - 1) / step), F.lit(0)).cast("int"))
    return w.select("doc_id", "w", F.explode(starts).alias("chunk_index")).select("doc_id", "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * step + 1, size), " ").alias("content"))


def chunk_sentences(docs: DataFrame, size: int = 1500) -> DataFrame:
    """J4. Sentences packed up to ``size`` characters, by a fold per text."""
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(s) <= size)
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open")))

    folded = docs.select("doc_id", F.aggregate(sentences, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))).alias("c"))
    return folded.select("doc_id", F.posexplode("c").alias("chunk_index", "content"))


def marker_sections(docs: DataFrame, keywords: Sequence[str], least_words: int = 30) -> DataFrame:
    """J5. First place of each key word starts a section that runs to the next one."""
    found = F.array(*(F.struct(F.instr(F.lower("text"), F.lit(k)).alias("at"), F.lit(k).alias("section")) for k in keywords))
    m = docs.select("doc_id", "text", F.inline(found)).filter("at > 0")
    nxt = F.lead("at").over(W.partitionBy("doc_id").orderBy("at", "section"))
    m = m.withColumn("next_at", nxt).withColumn("content", F.substring("text", F.col("at"), F.coalesce(F.col("next_at"), F.length("text") + 1) - F.col("at")))
    m = m.withColumn("words", F.size(F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " ")))
    return m.filter(F.col("words") >= least_words).select("doc_id", "section", "at", "words")


def speaker_turns(lines: DataFrame, pattern: str) -> DataFrame:
    """J6. A line that matches the speaker pattern starts a turn: running count of
    starts, then lines joined in order. ``lines``: (doc_id, line_no, line)."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    t = lines.withColumn("start", F.col("line").rlike(pattern)).withColumn("turn", F.sum(F.col("start").cast("int")).over(w)).filter("turn > 0")
    g = t.groupBy("doc_id", "turn").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("doc_id", "turn", F.regexp_extract(F.col("l")[0]["line"], pattern, 1).alias("speaker"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def split_call(docs: DataFrame, dividers: dict[str, float]) -> DataFrame:
    """J7. Prepared remarks and questions, at the divider of highest confidence."""
    found = F.array(*(F.struct(F.lit(c).alias("confidence"), (-F.instr(F.lower("text"), F.lit(p))).alias("neg"), F.instr(F.lower("text"), F.lit(p)).alias("at")) for p, c in dividers.items()))
    best = docs.withColumn("best", F.array_max(F.filter(found, lambda x: (x["at"] > 0) & (x["confidence"] >= 0.7))))
    at = F.coalesce(F.col("best.at"), F.length("text") + 1)
    return best.select("doc_id", F.col("best.confidence").alias("confidence"), (at - 1).alias("remarks_chars"), (F.length("text") - at + 1).alias("qa_chars"))


def assemble_sections(chunks: DataFrame, least: int = 100) -> DataFrame:
    """J8. Chunks joined in index order per filing and section."""
    g = chunks.groupBy("ticker", "filing_type", "filing_date", "section_type", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    out = g.withColumn("content", F.array_join(F.transform("c", lambda x: F.trim(x["content"])), " ")).drop("c")
    return out.filter(F.length("content") >= least)


def check_sections(sections: DataFrame, least: int = 3, words: int = 100) -> DataFrame:
    """J9. Documents with too few sections, or with short ones."""
    g = sections.groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(F.size(F.split("content", r"\s+")) < words).alias("short"))
    return g.withColumn("ok", (F.col("sections") >= least) & (F.col("short") == 0))


def label_recall(lines: DataFrame, facts: DataFrame, floor: float = 99.999) -> DataFrame:
    """J10. Share of table labels found among extracted ones, per filing."""
    have = facts.select("filing", F.lower("label").alias("key"), F.lit(1).alias("hit")).distinct()
    j = lines.select("filing", F.lower("label").alias("key")).distinct().join(have, ["filing", "key"], "left")
    g = j.groupBy("filing").agg(F.count("*").alias("labels"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.round(F.col("found") / F.col("labels") * 100, 6)).withColumn("passed", F.col("recall") >= floor)
