"""Preference formatting, in DataFrame functions only.

A chosen and a rejected conversation share a prompt: their longest common prefix
of turns, rendered once. What follows is rendered as two completions, each with
the spans that a loss may look at: what the assistant says, and its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END_MARK = "<|end|>"
ANSWERS = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turn: Column) -> Column:
    """A turn (struct of role and text) as text."""
    return F.concat(_head(turn), turn["text"], F.lit(END_MARK + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def _mask(turns: Column) -> Column:
    """[{start, end}] in characters of the rendered turns: assistants' texts with their end marks."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, turn: Column) -> Column:
        start = done["at"] + F.length(_head(turn))
        span = F.struct(start.alias("start"), (start + F.length(turn["text"]) + len(END_MARK)).alias("end"))
        spans = F.when(turn["role"] == ANSWERS, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((done["at"] + F.length(render(turn))).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step, lambda done: done["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, prompt, prompt_turns, chosen, chosen_mask, rejected, rejected_mask): one row per key of either side.

    Both take one row per turn. Turns are ordered by ``turn`` (nulls first; ties
    and repeated rows by role, then text, all kept); null roles and texts count
    as empty; null keys are one key. A key that one side lacks has an empty
    prompt and completion there; equal conversations are all prompt. Other
    columns are not read. One shuffle by key; a conversation is gathered whole,
    as its rendering is one value.
    """
    sides = []
    for is_chosen, df in ((True, chosen), (False, rejected)):
        said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        sides.append(df.select(F.col(key).alias("__key"), F.lit(is_chosen).alias("__chosen"), said.alias("__turn")))
    both = sides[0].unionByName(sides[1]).groupBy("__key").agg(
        F.sort_array(F.collect_list(F.when(F.col("__chosen"), F.col("__turn")))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("__chosen"), F.col("__turn")))).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, False)
    prefix = F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int")
    cut = both.withColumn("n", prefix).select(
        "__key",
        "n",
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        *(F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))).alias(x) for x in ("c", "r")),
    )
    return cut.select(
        F.col("__key").alias(key),
        _rendered(F.col("p")).alias("prompt"),
        F.col("n").cast("long").alias("prompt_turns"),
        _rendered(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def echo_pairs(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) made from single conversations.

    Chosen is a conversation up to its last answer; rejected is the same, but
    the last answer repeats the turn before it. Without an answer both are the
    whole conversation.
    """
    clean = turns.select(key, turn, F.coalesce(F.col(role), F.lit("")).alias(role), F.coalesce(F.col(text), F.lit("")).alias(text))
    order = Window.partitionBy(key).orderBy(F.col(turn).asc_nulls_first(), role, text)
    numbered = clean.withColumns({"__pos": F.row_number().over(order), "__echo": F.lag(text, 1, "").over(order)})
    last = F.max(F.when(F.col(role) == ANSWERS, F.col("__pos"))).over(Window.partitionBy(key))
    kept = numbered.withColumn("__last", last).where("__last is null or __pos <= __last")
    answer = F.when(F.col("__pos") == F.col("__last"), F.col("__echo")).otherwise(F.col(text))
    columns = [key, F.col("__pos").alias(turn), role]
    return kept.select(*columns, text), kept.select(*columns, answer.alias(text))
