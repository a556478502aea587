"""Chat formatting: preference pairs, in DataFrame operations only.

The turns that a chosen and a rejected conversation share from their start are the prompt, which
is rendered once; what follows are the two completions, each with the character spans on which a
model is trained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A turn is rendered as HEAD with its role, its text and END.  OPEN in a role or text is written as CLOSED, and what would
#: end a head early in a role as APART, so that neither forges a turn.
HEAD, END, OPEN, CLOSED, SHUT, APART = "<|%s|>\n", "<|end|>\n", "<|", "< |", "|>", "| >"


def shown_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit(OPEN), F.lit(CLOSED)), F.lit(SHUT), F.lit(APART))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), shown_role(role), F.lit("|>\n"), F.replace(text, F.lit(OPEN), F.lit(CLOSED)), F.lit(END))


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text: conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return conversations.filter(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), side.alias("side"), "turn", "role", "text")


def format_preferences(turns: DataFrame, learner: str = "assistant") -> DataFrame:
    """One row a pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``turns`` has pair_id, side (chosen or rejected), turn, role, text.  Masks are arrays of
    (start, end) in characters of the completion: texts of the ``learner`` and their end marks.

    Turns are in order of turn (null first), then role and text; repeated rows are turns of their
    own.  Null role: as ``unknown``.  Null text: as empty.  Null pair_id: left out, as such a turn
    belongs to no conversation.  A missing side: its completion and mask are null and the prompt
    is empty.  A side that is all prompt: its completion is empty.  Empty table: no rows.  The one
    exchange is by pair; a group is one pair's turns, which make one row of the result.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = rows.select("pair_id", "side", "turn", role.alias("role"), render_turn(role, text).alias("shown")).repartition("pair_id")
    in_order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "shown")
    rows = rows.withColumn("pos", F.row_number().over(in_order))
    abreast = Window.partitionBy("pair_id", "pos")
    same = (F.count(F.lit(1)).over(abreast) == 2) & (F.min("shown").over(abreast) == F.max("shown").over(abreast))
    rows = rows.withColumn("same", same.cast("int"))
    so_far = Window.partitionBy("pair_id", "side").orderBy("pos")
    rows = rows.withColumn("shared", F.min("same").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    length = F.when(F.col("shared"), 0).otherwise(F.length("shown"))
    rows = rows.withColumn("end", F.sum(length).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    start = F.col("end") - F.length("shown") + F.length("role") + F.lit(len(HEAD) - 2)
    piece = F.struct("pos", "shown", F.when(F.col("role") == learner, F.struct(start.cast("long").alias("start"), F.col("end").alias("end"))).alias("span"))

    def pieces(condition: Column, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, piece))).alias(name)

    chosen, rejected, shared = F.col("side") == "chosen", F.col("side") == "rejected", F.col("shared")
    pairs = rows.groupBy("pair_id").agg(pieces(chosen & shared, "p"), pieces(chosen & ~shared, "c"), pieces(rejected & ~shared, "r"), F.max(chosen).alias("has_c"), F.max(rejected).alias("has_r"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda x: x["shown"]), "")

    def mask(name: str) -> Column:
        return F.filter(F.transform(F.col(name), lambda x: x["span"]), lambda x: x.isNotNull())

    return pairs.select(
        "pair_id",
        F.size("p").cast("long").alias("n_prompt_turns"),
        joined("p").alias("prompt"),
        F.when(F.col("has_c"), joined("c")).alias("chosen"),
        F.when(F.col("has_r"), joined("r")).alias("rejected"),
        F.when(F.col("has_c"), mask("c")).alias("chosen_mask"),
        F.when(F.col("has_r"), mask("r")).alias("rejected_mask"),
    )
