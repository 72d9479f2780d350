"""Collapse of cumulative conversation snapshots, and chat rendering.

Logs often hold a conversation several times, once for each turn it had so far. A conversation
whose turns are the beginning of a longer one is dropped; of equal ones the smallest id stays.

Everything here is made of Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.sources.scratch import cut_lineage

_SEEDS = ("prefix-1", "prefix-2")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Number the turns of every conversation and hash each turn together with all before it.

    Turns are ordered by (turn, role, text), nulls first; a row logged twice counts once; numbers
    start at 1. The rolling hash adds (xor) a hash of (number, role, text) for every further turn, 128 bits in
    all, so equal hashes at equal numbers mean equal beginnings. A null role or text differs from
    an empty one. Rows without conv_id are conversations of one turn each.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = rows.withColumn("alone", alone)
    w = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    numbered = rows.withColumn("number", F.row_number().over(w))
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = numbered.withColumns(
        {f"h{i}": F.xxhash64(F.lit(seed), "number", *said) for i, seed in enumerate(_SEEDS)}
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.withColumns({f"p{i}": F.bit_xor(f"h{i}").over(running) for i in range(len(_SEEDS))}).drop("h0", "h1")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, alone, n_turns, copies) of the conversations that stay.

    Equal conversations are counted before anything is joined, and so are equal beginnings; the
    anti-join then sees each once, however common it is.
    """
    at = ["number", "p0", "p1"]
    sizes = prefixes.groupBy("conv_id", "alone").agg(
        F.max("number").alias("number"), F.max_by(F.struct("p0", "p1"), "number").alias("whole")
    )
    # a beginning is proper when its conversation goes on
    longer = prefixes.filter(F.col("number") > 1).select(
        (F.col("number") - 1).alias("number"),
        F.col("p0").bitwiseXOR(_turn_hash(0)).alias("p0"),
        F.col("p1").bitwiseXOR(_turn_hash(1)).alias("p1"),
    ).distinct()
    whole = sizes.select("conv_id", "alone", "number", "whole.p0", "whole.p1").groupBy(*at).agg(
        F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "alone")).alias("first"), F.count("*").alias("copies")
    )
    return whole.join(longer, at, "left_anti").select(
        "first.conv_id", "first.alone", F.col("number").alias("n_turns"), "copies"
    )


def _turn_hash(i: int) -> Column:
    """The hash that the turn itself added to its prefix."""
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return F.xxhash64(F.lit(_SEEDS[i]), "number", *said)


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered): the maximal conversations as chat text.

    Every turn becomes ``<|role|>``, a newline, the text, ``<|end|>`` and a newline; null roles and texts are
    empty. A conversation without a single row does not exist; an empty table gives none.
    """
    prefixes = cut_lineage(turn_prefixes(turns), "prefixes")
    kept = maximal(prefixes).withColumnsRenamed({"conv_id": "kept_id", "alone": "kept_alone"})
    mine = F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("alone").eqNullSafe(F.col("kept_alone"))
    said = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )
    return (
        prefixes.join(kept, mine)
        .groupBy("conv_id", "alone", "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("number", said.alias("said")))).alias("turns"))
        .select("conv_id", "n_turns", "copies", F.array_join("turns.said", "").alias("rendered"))
    )
