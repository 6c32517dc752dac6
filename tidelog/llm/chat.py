"""Preference formatting of chats, in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix, turns equal in role and text from the first
on, is rendered once as the prompt; what follows on either side is rendered as that side's completion. Masks are spans of
characters of prompt + completion that count in training: the texts of assistant turns of the completion, with their end mark.

The prefix is found turn by turn, by a join on (pair, position) and the least position where the two differ; only rendering
gathers a conversation, as one row of text must hold it.

Defined results: positions are ranks in the order of turn (null last), role, text, so gaps and ties do no harm; a null role or
text is an empty one; a side that is missing or no longer than the prefix has an empty completion; conversations of equal
turns have all of them as prompt; a null conv_id is no conversation and is left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, SPLIT, CLOSE = "<|", "|>\n", "<|end|>\n"


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id: conversations 2 k and 2 k + 1 are pair k; a side that isn't there is null."""
    ids = conversations.filter("conv_id IS NOT NULL").select("conv_id").distinct()
    odd = F.pmod("conv_id", F.lit(2)) == 1
    pair = F.floor((F.col("conv_id") - F.pmod("conv_id", F.lit(2))) / 2).cast("long")
    return ids.groupBy(pair.alias("pair_id")).agg(F.max(F.when(~odd, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(odd, F.col("conv_id"))).alias("rejected_id"))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SPLIT), text, F.lit(CLOSE))


def preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_prompt (turns), prompt, chosen, rejected, chosen_mask, rejected_mask."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    turns = turns.withColumn("at", at)
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("c").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("r").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x"))
    dealt = turns.join(sides.select("pair_id", "x.side", "x.conv_id"), "conv_id").select("pair_id", "side", "at", "role", "text")
    # Both sides of a position meet in a group of two; a position with one side differs.
    both = dealt.groupBy("pair_id", "at").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("b"))
    differs = (F.col("n") < 2) | (F.col("a") != F.col("b"))
    prefix = both.groupBy("pair_id").agg(F.min(F.when(differs, F.col("at"))).alias("_first"), F.max("at").alias("_all"))
    prefix = prefix.select("pair_id", F.coalesce(F.col("_first") - 1, F.col("_all")).cast("int").alias("n_prompt"))
    rendered = dealt.join(prefix, "pair_id").filter("NOT (side = 'r' AND at <= n_prompt)")
    part = F.when(F.col("at") <= F.col("n_prompt"), F.lit("p")).otherwise(F.col("side"))
    row = F.struct("at", _render(F.col("role"), F.col("text")).alias("x"), F.length(F.concat(F.lit(OPEN), "role", F.lit(SPLIT))).alias("head"), (F.col("role") == "assistant").alias("learn"))
    whole = rendered.groupBy("pair_id", "n_prompt", part.alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    wide = whole.groupBy("pair_id", "n_prompt").agg(*(F.max(F.when(F.col("part") == p, F.col("rows"))).alias(p) for p in "pcr"))
    out = pairs.join(wide, "pair_id", "left")
    nothing = F.expr("cast(array() as array<struct<at:int,x:string,head:int,learn:boolean>>)")
    out = out.withColumns({p: F.coalesce(F.col(p), nothing) for p in "pcr"})

    def text(p: str) -> Column:
        return F.array_join(F.transform(F.col(p), lambda t: t["x"]), "")

    def mask(p: str) -> Column:
        """[start, end) of what is learnt, in characters of prompt + completion."""
        step = F.aggregate(
            F.col(p), F.struct(F.length("prompt").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
            lambda s, t: F.struct(
                (s["at"] + F.length(t["x"])).alias("at"),
                F.when(t["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + t["head"]).alias("start"), (s["at"] + F.length(t["x"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
            ),
        )
        return step["spans"]

    out = out.withColumn("prompt", text("p"))
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("n_prompt", F.lit(0)).alias("n_prompt"), "prompt", text("c").alias("chosen"), text("r").alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask")
    )
