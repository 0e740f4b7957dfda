"""Preference formatting of conversations (operator 7), DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is rendered as its completion,
with the ranges of code points that training may learn from: the assistant's
turns. One shuffle by pair brings the two sides together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose turns are learned from.
LEARNED_ROLE = "assistant"
#: A turn is rendered as OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.getField("role"), F.lit(CLOSE))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn.getField("text"), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Ranges of a rendered completion that are learned: text and end mark of
    the learned role's turns."""
    state = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        at = acc.getField("at")
        end = at + F.length(_rendered(t))
        span = F.array(F.struct((at + F.length(_head(t))).alias("start"), (end - 1).alias("end")))
        out = F.when(t.getField("role") == LEARNED_ROLE, F.concat(acc.getField("out"), span)).otherwise(acc.getField("out"))
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(turns, state, step, lambda acc: acc.getField("out"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row a pair from rows ``pair_id, side, turn, role, text``, where side
    is 'chosen' or 'rejected'.

    Returns ``pair_id, status, prefix_turns, prompt, chosen, rejected,
    chosen_mask, rejected_mask``. Turns are in order of turn, then role, then
    text; rows alike in all of these count once. Null roles and texts are empty;
    a null turn comes first. status: 'pair'; 'identical' (no completion differs);
    'chosen_only' or 'rejected_only' (the other side has no turns: all is
    prompt, the completions are empty). Rows with null pair_id or another side
    belong to no pair and are left out.
    """
    t = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(
        "pair_id", "side", F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))

    def side(name: str) -> Column:
        return F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t"))))).alias(name[0])

    both = t.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    # Turns agree in role and text; their numbers may differ.
    alike = F.zip_with("c", "r", lambda a, b: F.coalesce(
        (a.getField("role") == b.getField("role")) & (a.getField("text") == b.getField("text")), F.lit(False)))
    first_other = F.array_position(alike, False)
    prefix = F.when(F.size("c") == 0, F.size("r")).when(F.size("r") == 0, F.size("c")) \
        .when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int")
    both = both.withColumn("n", prefix)
    longer = F.when(F.size("c") >= F.size("r"), F.col("c")).otherwise(F.col("r"))
    rest_c, rest_r = (F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in ("c", "r"))
    status = F.when(F.size("c") == 0, "rejected_only").when(F.size("r") == 0, "chosen_only") \
        .when((F.size("c") == F.col("n")) & (F.size("r") == F.col("n")), "identical").otherwise("pair")
    return both.select(
        "pair_id", status.alias("status"), F.col("n").alias("prefix_turns"), _render(F.slice(longer, 1, F.col("n"))).alias("prompt"),
        _render(rest_c).alias("chosen"), _render(rest_r).alias("rejected"), _mask(rest_c).alias("chosen_mask"), _mask(rest_r).alias("rejected_mask"))


def joined_mask(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")
