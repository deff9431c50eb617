"""Preference formatting: one prompt, and a chosen and a rejected completion to train on.

The turns that both conversations of a pair begin with are rendered once, as the
prompt; what follows in either is its completion, with a mask of the characters
that an assistant says. Only DataFrame functions are used: places of messages
are running sums over a conversation, so that work is in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a message is rendered (fixed values).
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

def rendered(role: Column, text: Column) -> Column:
    """A message as a string."""
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def preferences(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Prompts and masked completions of ``messages`` (pair_id, chosen, turn, role, text).

    ``chosen`` is true for the messages of the preferred conversation. Gives
    pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask
    for every pair, in one row, which is as long as its conversations. A mask
    has [start, end) of what messages of the role ``trained`` say, their end
    sign with it, in characters of the completion.

    A turn is the set of its messages: repeated rows count once, and messages
    of one turn stand in the order of role and text. Null roles and texts are
    empty, null turns come before all others, and rows of a null pair or side
    belong to no pair and are left out. A conversation that begins with all of
    the other has an empty completion opposite; a pair without one side has an
    empty prompt. No rows give no rows. Other columns are ignored.
    """
    said = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = messages.where("pair_id is not null and chosen is not null").select("pair_id", "chosen", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), said.alias("m"))
    side = lambda of: F.sort_array(F.collect_set(F.when(of, F.col("m"))))
    turns = rows.groupBy("pair_id", "turn").agg(side(F.col("chosen")).alias("c"), side(~F.col("chosen")).alias("r"))
    first = turns.where(F.col("c") != F.col("r")).groupBy("pair_id").agg(F.min("turn").alias("first"))
    whole = turns.join(first, "pair_id", "left").withColumn("shared", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    parts = F.when(F.col("shared"), F.array(F.struct(F.lit("p").alias("part"), F.col("c").alias("own")))).otherwise(F.array(*[F.struct(F.lit(x).alias("part"), F.col(x).alias("own")) for x in "cr"]))
    placed = whole.select("pair_id", "turn", "shared", F.explode(parts).alias("x")).select("pair_id", "turn", "shared", "x.part", F.posexplode_outer("x.own").alias("nth", "m"))
    placed = placed.withColumn("message", rendered(F.col("m.role"), F.col("m.text")))
    before = Window.partitionBy("pair_id", "part").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("message")).over(before), F.lit(0)) + F.length(F.concat(F.lit(OPEN), F.col("m.role"), F.lit(MIDDLE)))
    end = begin + F.length(F.concat(F.col("m.text"), F.lit(CLOSE)))
    placed = placed.withColumn("mask", F.when((F.col("m.role") == trained) & (F.col("part") != "p"), F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))))
    own = lambda x: F.sort_array(F.collect_list(F.when((F.col("part") == x) & F.col("message").isNotNull(), F.struct("turn", "nth", "message"))))
    text = lambda x: F.array_join(F.transform(x, lambda y: y["message"]), "")
    spans = lambda x: F.sort_array(F.collect_list(F.when(F.col("part") == x, F.col("mask"))))
    pairs = placed.groupBy("pair_id").agg(
        F.count_distinct(F.when(F.col("shared"), F.col("turn"))).alias("prompt_turns"),
        *[own(x).alias(x) for x in "pcr"],
        spans("c").alias("chosen_mask"),
        spans("r").alias("rejected_mask"),
    )
    return pairs.select("pair_id", "prompt_turns", text("p").alias("prompt"), text("c").alias("chosen"), "chosen_mask", text("r").alias("rejected"), "rejected_mask")


def other_endings(conversations: DataFrame) -> DataFrame:
    """Pairs for :func:`preferences`: each conversation, and itself with the last assistant turn of the next one by conv_id.

    Without a next one the rejected side lacks that turn; a conversation in
    which no assistant speaks is its own rejected side.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.where("pair_id is not null")
    last = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = last.select("pair_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("donor"))
    ending = last.select("pair_id", "last_turn").join(last.select((F.col("pair_id") - 1).alias("pair_id"), "donor"), "pair_id", "left")
    swapped = rows.join(ending, "pair_id", "left")
    own = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    rejected = swapped.where(~F.coalesce(own, F.lit(False)) | F.col("donor").isNotNull())
    rejected = rejected.select("pair_id", F.lit(False).alias("chosen"), "turn", "role", F.when(F.coalesce(own, F.lit(False)), F.col("donor")).otherwise(F.col("text")).alias("text"))
    return rows.select("pair_id", F.lit(True).alias("chosen"), "turn", "role", "text").unionByName(rejected)
