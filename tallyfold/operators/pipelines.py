"""Composed retrieval and the extension points: formulas, overlays, mappings, chunkers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallyfold.operators.chunking import char_windows
from tallyfold.operators.facts import ranked
from tallyfold.operators.hierarchy import ordered
from tallyfold.operators.ratios import evaluate
from tallyfold.operators.resolve import next_version, resolve_with_overlay
from tallyfold.operators.search import budget, search_chunks, with_neighbours
from tallyfold.operators.text_index import TextIndex


def _searched(queries: DataFrame, chunks: DataFrame | TextIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits, and the chunks they are of: from an index where there is one."""
    if isinstance(chunks, TextIndex):
        return chunks.search(queries, k), chunks.texts
    return search_chunks(queries, chunks, k), chunks


def search_multi(queries: DataFrame, chunks: DataFrame | TextIndex, k: int) -> DataFrame:
    """K2. The cascade for each query and ticker over that ticker's chunks, best k of each.
    ``queries``: (query_id, ticker, phrase, terms)."""
    each = F.concat_ws("|", F.col("query_id").cast("string"), "ticker")
    hits, _ = _searched(queries.withColumn("query_id", each), chunks, k)
    back = queries.select(each.alias("each"), "query_id", "ticker").distinct()
    return hits.withColumnRenamed("query_id", "each").join(back, "each").select("query_id", "ticker", "doc_id", "chunk_index", "stage", "score")


def context_metrics(terms: DataFrame, synonyms: DataFrame, facts: DataFrame, default: Sequence[str]) -> DataFrame:
    """K4. Latest facts of the metrics a query's terms resolve to; the default ones when
    none does. ``terms``: (query_id, term)."""
    named = terms.withColumn("key", F.lower("term")).join(synonyms.select(F.lower("name").alias("key"), "canonical"), "key", "left")
    got = named.filter("canonical is not null").select("query_id", F.col("canonical").alias("metric")).distinct()
    none = terms.select("query_id").distinct().join(got, "query_id", "left_anti").withColumn("metric", F.explode(F.array(*(F.lit(m) for m in default))))
    last = ranked(facts.filter("filing_type = '10-K'"), ["ticker", "metric"], F.desc("filing_date"), "fiscal_period")
    return got.unionByName(none).join(last, "metric").select("query_id", "ticker", "metric", "fiscal_period", "value")


def retrieve_context(queries: DataFrame, chunks: DataFrame | TextIndex, k: int, max_tokens: int) -> DataFrame:
    """K5. Search, budget, neighbours as one plan."""
    hits, texts = _searched(queries, chunks, k)
    hits = hits.join(texts.select("doc_id", "chunk_index", "section_type", "content"), ["doc_id", "chunk_index"])
    kept = budget(hits.withColumn("id", F.struct("doc_id", "chunk_index")), max_tokens)
    return with_neighbours(kept, texts, max_tokens)


def register_formulas(formulas: DataFrame, facts: DataFrame) -> DataFrame:
    """P1. Approved formulas of a table (name, formula, status), evaluated. They become
    columns of one plan; more than 1000 are an error."""
    rows = formulas.filter("status = 'approved'").select("name", "formula").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 approved formulas: evaluate them in parts")
    return evaluate(facts, {r["name"]: r["formula"] for r in rows})


def load_overlay(queries: DataFrame, base: DataFrame, overlays: DataFrame, tenant: str) -> DataFrame:
    """P2. Resolution with one tenant's overlay."""
    return resolve_with_overlay(queries, base, overlays.filter(F.col("tenant") == tenant).select("name", "canonical"))


def add_mapping(mappings: DataFrame, new: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P3. The mapping table with new tags, its next version, and the filings that hold
    such a tag and are to be read again."""
    out = mappings.select("tag", "canonical").join(new.select("tag"), "tag", "left_anti").unionByName(new.select("tag", "canonical"))
    return out, next_version(mappings), filings.join(new.select(F.col("tag").alias("raw_label")), "raw_label", "left_semi")


def with_embedding(df: DataFrame, fn: Callable, col: str = "content") -> DataFrame:
    """P4. A vector column by the caller's function over batches of texts."""
    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts.tolist())))

    return df.withColumn("v", vector(col))


@udtf(returnType="chunk_index int, start long, content string")
class ChunkText:
    """P5. ``chunk_text(text, size, overlap)`` as a table function."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for k, (a, part) in enumerate(char_windows(text or "", size, overlap)):
            yield k, a, part


def statement_tree(rows: DataFrame) -> DataFrame:
    """N3. Statement rows (id, parent, pos, name, value) in pre-order with indent."""
    return ordered(rows.select("id", "parent", "pos")).join(rows.select("id", "name", "value"), "id")
