"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is written as OPEN role CLOSE text END; OPEN inside a text is written with a space.
OPEN, CLOSE, END = "<|", "|>\n", "\n"
LEARNED = "assistant"


def _turns(side: Column) -> Column:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.replace(text, F.lit(OPEN), F.lit("< |")).alias("text"))
    return F.sort_array(F.collect_list(F.when(side, turn)))


def _written(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _written), "")


def _mask(turns: Column) -> Column:
    """Character ranges of a rendered completion that are learned: texts of assistant turns with their end mark."""

    def add(at: Column, t: Column) -> Column:
        begin = at["n"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE)))
        end = begin + F.length(t["text"]) + len(END)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("n"), F.when(t["role"] == LEARNED, F.concat(at["spans"], F.array(span))).otherwise(at["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, add, lambda at: at["spans"])


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row a pair: pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, usable.

    Input: turn (order in the conversation), role, text; `pair` names the pair and `chosen` is true for turns of its
    preferred conversation, false for the other's; turns where either is null are left out. Other columns are ignored.

    The prompt is the longest common prefix of turns (same role and text), rendered once; the completions are what follows on
    either side, with the character ranges to learn (assistant texts). usable: both conversations are there and differ, and both completions have something to learn.
    Null roles and texts count as empty; turns of equal number are ordered by role and text. A pair lacking one side has an empty one.
    One shuffle by pair; a pair's turns meet in one row, which is the example itself.
    """
    known = turns.select(pair.cast("long").alias("pair_id"), chosen.alias("side"), "turn", "role", "text").where("pair_id is not null and side is not null")
    grouped = known.groupBy("pair_id").agg(_turns(F.col("side")).alias("a"), _turns(~F.col("side")).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    common = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1
    cut = grouped.withColumn("n_common", common.cast("long"))
    tail = {s: F.slice(s, F.col("n_common").cast("int") + 1, F.greatest(F.size(s) - F.col("n_common").cast("int"), F.lit(0))) for s in ("a", "b")}
    parts = cut.select("pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common").cast("int")).alias("p"), tail["a"].alias("x"), tail["b"].alias("y"), ((F.size("a") > 0) & (F.size("b") > 0)).alias("both"))
    out = parts.select("pair_id", "n_common", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("x")).alias("chosen"), _rendered(F.col("y")).alias("rejected"), _mask(F.col("x")).alias("chosen_mask"), _mask(F.col("y")).alias("rejected_mask"), "both")
    usable = F.col("both") & (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)
    return out.withColumn("usable", usable).drop("both")
