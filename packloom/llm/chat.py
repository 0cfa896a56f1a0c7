"""Preference formatting of conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_HEAD_END, TURN_END = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit(TURN_HEAD_END), t["text"], F.lit(TURN_END))), "")


def learned_spans(turns: Column) -> Column:
    """Where a completion is learned from: "start:length" in characters of each text of LEARNED_ROLE with its end mark, joined by commas."""
    head = lambda t: F.length(t["role"]) + len(TURN_START) + len(TURN_HEAD_END)
    body = lambda t: F.length(t["text"]) + len(TURN_END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.concat((acc["at"] + head(t)).cast("string"), F.lit(":"), body(t).cast("string"))
        return F.struct((acc["at"] + head(t) + body(t)).alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """From rows (pair_id, side 0 for chosen and 1 for rejected, turn, role, text), one training example for each pair.

    The longest common prefix of turns (same role and text) is rendered once, as prompt; what follows it on either side
    is that side's completion, with the spans that a loss may use. One shuffle by pair; an example is one row, so a row
    holds the turns of two conversations and no more.

    Turns stand in the order of (turn, role, text), null turns last; rows that repeat are turns of their own. Null role or
    text: empty. A pair of which one side is missing has the other side as its completion, an empty prompt, and null for
    the missing side. Two equal conversations give a prompt and two empty completions. Rows with a null pair_id or another
    side are no pair's and are left out. An empty table gives no rows.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda i: F.array_sort(F.collect_list(F.when(F.col("side") == i, turn)))
    both = turns.where("pair_id is not null and side in (0, 1)").groupBy("pair_id").agg(side(0).alias("a"), side(1).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    unlike = lambda i: (F.col("a")[i]["role"] != F.col("b")[i]["role"]) | (F.col("a")[i]["text"] != F.col("b")[i]["text"])
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))), lambda i: (i < least) & unlike(i)))
    cut = both.withColumn("common", F.coalesce(first, least))
    after = lambda c: F.expr(f"slice({c}, common + 1, size({c}))")
    cut = cut.withColumn("head", F.expr("slice(a, 1, common)")).withColumn("chosen_turns", after("a")).withColumn("rejected_turns", after("b"))
    has = lambda c, x: F.when(F.size(c) > 0, x)
    return cut.select(
        "pair_id", F.col("common").cast("long").alias("n_prompt_turns"), F.size("a").cast("long").alias("n_chosen_turns"), F.size("b").cast("long").alias("n_rejected_turns"),
        render(F.col("head")).alias("prompt"), has("a", render(F.col("chosen_turns"))).alias("chosen"), has("b", render(F.col("rejected_turns"))).alias("rejected"),
        has("a", learned_spans(F.col("chosen_turns"))).alias("chosen_mask"), has("b", learned_spans(F.col("rejected_turns"))).alias("rejected_mask"),
    )
