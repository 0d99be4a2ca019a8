"""Chat formatting: reply trees by iterative self-joins.

Messages point at their parent. Every round joins the messages with themselves on
(conversation, ancestor) and so doubles how far each one sees towards its root; after
about log2(depth) rounds every message knows its depth and the score summed on its way.
Leaves are ranked per conversation by mean score; the members of the chosen leaves'
paths are found by the same jumps, read backwards, so only chosen paths are spelled out
and each message at most once per path. Rounds carry ids and scores, never texts.

A path becomes one text by the template: ``<|role|>``, a line end, the escaped text,
``<|end|>``, a line end. Inside texts and roles a backslash is doubled, and one is put
after the first character of every control string, so no text can end or open a turn
and ``unescape`` gives it back exactly.

Results on odd input: a null text or role is empty; a parent that is not there makes a
root; messages on or below a cycle have no root and are in no path; rows without an id
form one conversation, so one task numbers them and writes their one text, as for any
conversation of that length; ties in score go to the smallest leaf; repeated rows of a
linear conversation are turns of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, table

# fixed values: strings with a meaning in this or in common chat templates
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<pad>", "<unk>", "<mask>", "[SYS]", "[/SYS]")
_control = re.compile("|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL), re.I)
_escaped = re.compile(r"\\(\\?)")
_turn = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
NO_CONVERSATION = -(2**63)


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a path and the spans under the loss mask: the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


def linear(rows: DataFrame) -> DataFrame:
    """Messages of conversations that have turns instead of parents: each row replies
    to the one before it."""
    key = F.coalesce("conv_id", F.lit(NO_CONVERSATION)).alias("conv")
    number = F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", number).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))
    return rows.select("conv", "id", "parent", "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv, leaf, rank, id, depth) of the messages on the ``top`` best paths."""
    links = messages.select("conv", "id", "parent", "score")
    there = links.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    jump = links.join(there, ["conv", "parent"], "left").select("conv", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops"))
    state = materialize(jump, "jump")
    rounds, jumps, done = max(1, int(state.count()).bit_length()), [], state.filter("up is null")
    active = state.filter("up is not null")
    inner = active.select("conv", F.col("up").alias("id")).distinct()
    while len(jumps) < rounds and not active.isEmpty():  # only messages that do not see their root yet
        jumps.append(active)
        far = done.unionByName(active).select("conv", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        both = active.join(far, ["conv", "up"])
        step = both.select("conv", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("hops") + F.col("hops2")).alias("hops"))
        step = materialize(step, "jump")
        done, active = done.unionByName(step.filter("up is null")), step.filter("up is not null")
    whole = done.select("conv", "id", "total", "hops")
    leaves = whole.join(inner, ["conv", "id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("hops")), "id"))
    path = leaves.withColumn("rank", rank).filter(F.col("rank") <= top).select("conv", F.col("id").alias("leaf"), "rank", "id")
    for jump in reversed(jumps):  # every ancestor's distance is one sum of powers of two
        path = path.unionByName(path.join(jump.select("conv", "id", "up"), ["conv", "id"]).select("conv", "leaf", "rank", F.col("up").alias("id")))
        path = materialize(path, "path")
    return path.join(whole, ["conv", "id"]).select("conv", "leaf", "rank", "id", F.col("hops").alias("depth"))


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss: one row per chosen path. A path's messages
    meet in one row because the result is one text."""
    members = chosen_paths(messages, top).join(messages.select("conv", "id", "role", "text"), ["conv", "id"])
    turns = members.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"].to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["leaf"], batch["rank"], pa.array([t for t, _ in got], pa.string()), loss], names=["conv", "leaf", "rank", "formatted", "loss"])

    schema = "conv long, leaf long, rank int, formatted string, loss array<struct<start:long,end:long>>"
    made = turns.mapInArrow(run, schema)
    return made.select(F.when(F.col("conv") != NO_CONVERSATION, F.col("conv")).alias("conv_id"), "leaf", "rank", "formatted", "loss")


def read_back(made: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the output alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for conv, text, loss in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
                turns = parsed(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return made.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = materialize(conversations(linear(rows.unionByName(extra))), "formatted")
    return read_back(made)


OP5_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + length(regexp_replace(text, '<(\\||/?s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>|pad>|unk>|mask>)|\\|>|\\[/?(INST|SYS)\\]', '\\0!', 'gi')) - length(text) as written
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(written + length(role) + 13)::bigint as formatted_chars
from e group by conv_id
"""
