"""Preference formatting: one prompt, and a chosen and a rejected completion.

For each pair of conversations the longest common prefix of turns (same role and
text) is rendered once, as the prompt; the turns that follow in either conversation
are its completion.  A completion comes with the character spans that a loss counts:
the text and end mark of the turns of ``trained_role``; headers and other turns are
masked.

The turns of both conversations of a pair meet in one shuffle on the pair, where a
running sum gives each turn's place in its rendering; all the rest is array
expressions on the pair's row, linear in its turns.  A record is as large as its two
conversations; a conversation that many pairs name is dealt out by pair.

Defined cases: turns go by number, then role, then text, so ties have one order and
repeated rows are repeated turns; a null role or text equals null and renders as
empty; turns with a null conversation belong to none; repeated rows of pairs count
once, and of several conversations for a side of a pair the least id is taken; a pair one side of which is
missing has an empty prompt and a null completion there; identical conversations are
all prompt, with empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendering: what stands before a role, after it, and after the text.
OPEN, HEAD_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def paired_by_id(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(pair_id, side, conv_id)``: conversation 2k is the chosen and 2k+1 the rejected one of pair k."""
    known = conversations.select(F.col(conv_col).alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    return known.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "conv_id")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(HEAD_END))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def loss_spans(turns: Column, base: Column, trained_role: str) -> Column:
    """``(begin, end)`` of the characters that the loss counts in a rendering that begins ``base`` characters into its conversation."""
    own = F.filter(turns, lambda t: t["role"] == trained_role)
    return F.transform(own, lambda t: F.struct((t["before"] - base + F.length(_header(t))).cast("int").alias("begin"), (t["before"] - base + F.length(_header(t)) + F.length(_body(t))).cast("int").alias("end")))


def _side(side: str) -> Column:
    turns = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("place", "role", "text", "before"))))
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["before"].alias("before")))


def last_turn_from(conversations: DataFrame, partners: DataFrame, role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with the text of their last turn of ``role`` taken from another, named ``-1 - conv_id``.

    ``partners`` is ``(conv_id, partner)``.  A conversation that has no such turn, or
    whose partner has none, is left out; of several turns with the last number the
    greatest text is taken, and all of them get the new one.
    """
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    last = turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").alias("partner"), F.col("last.text").alias("other"))
    asked = partners.select("conv_id", "partner").join(other, "partner").join(last.select("conv_id", F.col("last.turn").alias("at")), "conv_id")
    new = F.when((F.col("role") == role) & (F.col("turn") == F.col("at")), F.col("other")).otherwise(F.col("text"))
    return turns.join(asked, "conv_id").select((-1 - F.col("conv_id")).alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), new.alias(text_col))


def preference_records(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``pairs`` has pair_id, side (``chosen`` or ``rejected``) and conv_id.
    """
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    named = pairs.groupBy("pair_id", "side").agg(F.min("conv_id").alias("conv_id"))
    met = turns.join(named, "conv_id").repartition("pair_id")
    in_order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    size = F.length(_header(F.struct("role"))) + F.length(_body(F.struct("text")))
    met = met.withColumn("place", F.row_number().over(in_order)).withColumn("upto", F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - size)
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("conv_id")))
    both = met.groupBy("pair_id").agg(one("chosen").alias("chosen_id"), one("rejected").alias("rejected_id"), _side("chosen").alias("c"), _side("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differ = F.array_position(same, F.lit(False))
    both = both.withColumn("prefix_turns", F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("long"))
    after = lambda side: F.slice(side, (F.col("prefix_turns") + 1).cast("int"), F.size(side))
    both = both.withColumn("prompt", render(F.slice("c", F.lit(1), F.col("prefix_turns").cast("int")))).withColumn("c", after("c")).withColumn("r", after("r"))
    there = lambda side, value: F.when(F.col(f"{side}_id").isNotNull(), value)
    base = F.length("prompt")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "prefix_turns", "prompt",
        there("chosen", render(F.col("c"))).alias("chosen"), there("rejected", render(F.col("r"))).alias("rejected"),
        there("chosen", loss_spans(F.col("c"), base, trained_role)).alias("chosen_spans"), there("rejected", loss_spans(F.col("r"), base, trained_role)).alias("rejected_spans"),
    )
