"""Preference pairs from chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once


def rendered(turn: Column) -> Column:
    """One turn in the chat format."""
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order; repeated turn numbers are ordered by role and text, null fields are empty."""
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))).alias("turns"))


def _completion(turns: Column, prefix: Column) -> Column:
    return F.slice(turns, prefix + 1, F.greatest(F.size(turns) - prefix, F.lit(0)))


def _mask(rest: Column) -> Column:
    """Character spans [start, end) of the completion that are trained: the text of assistant turns with its line feed."""
    walked = F.aggregate(
        rest,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() AS array<struct<start:long,end:long>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(rendered(t))).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["role"]) + 5).cast("long").alias("start"),
                (acc["at"] + F.length(rendered(t))).cast("long").alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return walked


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pairs`` has pair_id, chosen_id and rejected_id. The longest common prefix
    of turns (same role and text) is rendered once as the prompt; what follows
    in either conversation is its completion, and its mask lists the character
    spans of assistant turns, the only ones trained.

    Equal conversations have empty completions; a conversation that is missing
    or null counts as one without turns; turns with a null conv_id belong to no
    pair; repeated pairs give a row each; an empty table gives an empty result.
    """
    talks = conversation_turns(turns.where(F.col("conv_id").isNotNull()))
    none = F.expr("cast(array() AS array<struct<turn:long,role:string,text:string>>)")
    met = (
        pairs.select("pair_id", F.col("chosen_id").cast("long").alias("chosen_id"), F.col("rejected_id").cast("long").alias("rejected_id"))
        .join(talks.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("good")), "chosen_id", "left")
        .join(talks.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("bad")), "rejected_id", "left")
        .select("pair_id", F.coalesce("good", none).alias("good"), F.coalesce("bad", none).alias("bad"))
    )
    same = F.zip_with("good", "bad", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    prefix = F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")
    cut = computed_once(met, _prefix=prefix)
    split = computed_once(
        cut, _prompt=F.slice("good", 1, F.col("_prefix")),
        _good=_completion(F.col("good"), F.col("_prefix")), _bad=_completion(F.col("bad"), F.col("_prefix")))

    def text(c: str) -> Column:
        return F.array_join(F.transform(c, rendered), "")

    return split.select(
        "pair_id", F.col("_prefix").cast("long").alias("n_prompt_turns"), text("_prompt").alias("prompt"),
        text("_good").alias("chosen"), text("_bad").alias("rejected"),
        _mask(F.col("_good")).alias("chosen_mask"), _mask(F.col("_bad")).alias("rejected_mask"))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs for preference data from plain conversations.

    The chosen conversation is the one given (id 2c); the rejected one (id 2c + 1) is the same
    with its last assistant turn answered by the last assistant turn of the neighbour, conversation
    c + 1 for even c and c - 1 for odd c. Without such turns both are equal.
    """
    given = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    replies = given.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max(F.struct("turn", "text"))["text"].alias("reply"))
    neighbour = replies.select((F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))).alias("conv_id"), F.col("reply").alias("other"))
    swaps = replies.select("conv_id", "last").join(neighbour, "conv_id")
    changed = given.join(swaps, "conv_id", "left").withColumn(
        "text", F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.col("other")).otherwise(F.col("text")))
    both = given.withColumn("conv_id", F.col("conv_id") * 2).unionByName(
        changed.select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", "text"))
    pairs = given.select(F.col("conv_id").alias("pair_id")).distinct().select(
        "pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
    return both, pairs
