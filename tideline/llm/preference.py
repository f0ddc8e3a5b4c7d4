"""Preference formatting of paired conversations.

The turns that a chosen and a rejected conversation have in common at their start
are rendered once as the prompt; what follows on either side is its completion,
with spans that mark the assistant's words as the part to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: ``pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen,
    rejected, chosen_mask, rejected_mask``.

    ``turns``: ``conv_id, turn, role, text``; ``pairs``: ``pair_id, chosen_id, rejected_id``,
    other columns of either are left out. Turns are taken in the order of turn, role, text;
    null roles and texts are empty. Turns are equal when role and text are. Masks are
    ``start:end`` code points (end exclusive) of assistant texts in the completion,
    comma-joined. Of equal conversations both completions are empty. A pair that lacks a side
    has no prompt and an empty completion on that side. Repeated turns are turns of their own;
    repeated rows of ``pairs`` count once, and a null ``conv_id`` belongs to no pair. Texts of
    any length are rendered whole; empty tables give no rows.
    """
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id").distinct()
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("pos"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")),
            F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")),
        )
    )
    wanted = pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.side", "s.conv_id").filter("conv_id is not null")
    # Dealt by pair once; what follows groups and orders within pairs and needs no other exchange.
    t = t.join(wanted, "conv_id").repartition(partitions(turns.sparkSession), "pair_id")
    turn = F.struct("role", "text")
    t = t.groupBy("pair_id", "pos").agg(*(F.max(F.when(F.col("side") == k, turn)).alias(f"t{k}") for k in (0, 1)))
    order = Window.partitionBy("pair_id").orderBy("pos")
    alike = F.coalesce(F.col("t0") == F.col("t1"), F.lit(False))
    t = t.withColumn("shared", F.min(alike).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    for k in (0, 1):
        role, text = F.col(f"t{k}.role"), F.col(f"t{k}.text")
        t = t.withColumn(f"shown{k}", F.when(~F.col("shared") & F.col(f"t{k}").isNotNull(), render(role, text)))
        start = F.coalesce(F.sum(F.length(f"shown{k}")).over(ahead), F.lit(0)) + F.length(role) + len(OPEN) + 1
        span = F.concat_ws(":", start, start + F.length(text))
        t = t.withColumn(f"span{k}", F.when(F.col(f"shown{k}").isNotNull() & (role == "assistant"), span))
    t = t.withColumn("prompt", F.when(F.col("shared"), render(F.col("t0.role"), F.col("t0.text"))))

    def joined(column: str, by: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("pos", F.col(column).alias("x")))))
        return F.array_join(F.transform(rows, lambda r: r["x"]), by).alias(column)

    out = t.groupBy("pair_id").agg(
        F.count_if("shared").alias("n"), joined("prompt", ""), *(joined(f"{c}{k}", by) for k in (0, 1) for c, by in (("shown", ""), ("span", ",")))
    )
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return pairs.join(out, "pair_id", "left").select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_prompt_turns"), text("prompt", "prompt"),
        text("shown0", "chosen"), text("shown1", "rejected"), text("span0", "chosen_mask"), text("span1", "rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs of a table without preferences, for :func:`preference_pairs`.

    Every conversation c of a non-negative id is chosen over a copy, numbered -1 - c, whose
    last assistant turn says what that of its neighbour (2k and 2k + 1 are neighbours) says;
    of several assistant rows in the last such turn all are replaced, by the neighbour's
    greatest text. A conversation that lacks an answer or an answering neighbour has no
    rejected side.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter("conv_id >= 0")
    answers = t.filter("role = 'assistant' and turn is not null").groupBy("conv_id")
    last = answers.agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("said"))).alias("a"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("a.said").alias("other"))
    swap = last.join(other, "conv_id").select("conv_id", F.col("a.turn").alias("at"), "other")
    copies = t.join(swap, "conv_id").select(
        (-1 - F.col("conv_id")).alias("conv_id"),
        "turn",
        "role",
        F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.col("other")).otherwise(F.col("text")).alias("text"),
    )
    ids = t.select("conv_id").distinct().join(swap.select("conv_id", F.lit(True).alias("has")), "conv_id", "left")
    pairs = ids.select(
        F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.when(F.col("has"), -1 - F.col("conv_id")).alias("rejected_id")
    )
    return t.unionByName(copies), pairs
