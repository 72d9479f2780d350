"""Exact quantiles and ranks of groups that may be far larger than one task.

Both work in two steps. Every value falls into a coarse cell (a step of about 0.1 % in
magnitude, so order between cells equals order between values). Cell counts are small and come
from one map-side combined aggregate; they tell how many values lie before each cell. Sorting
then happens inside cells only, so a group is spread over many tasks. The cell is a function of
the value alone, hence recomputed tasks always agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 1000  # cells per factor e in magnitude
_LARGEST = 1.7e308  # infinities share the outermost cell
_SHIFT = 800_000  # lifts floor(ln(x) * _STEPS) above zero for every positive double


def value_cell(value: Column) -> Column:
    """Coarse cell of a double, non-decreasing in the value."""
    size = F.floor(F.ln(F.least(F.abs(value), F.lit(_LARGEST))) * _STEPS) + _SHIFT
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size).cast("long")


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per group: keys, one column per prob, and ``n``.

    Nulls are ignored. Groups without a value give no row.
    """
    keys = list(keys)
    data = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .withColumn("_cell", value_cell(F.col("_v")))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    cells = data.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    cells = cells.withColumn(
        "_below",
        F.coalesce(
            F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).withColumn("_total", F.sum("_n").over(group))

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def holds(pos: Column, first: Column, count: Column) -> Column:
        return (first <= pos) & (pos < first + count)

    wanted = F.lit(False)
    for p in probs.values():
        for edge in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | holds(edge, F.col("_below"), F.col("_n"))
    picked = cells.filter(wanted).select(*keys, "_cell", "_below", "_total")

    inside = Window.partitionBy(*keys, "_cell").orderBy("_v")
    ties = (
        data.join(picked, [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_below", "_total", "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_first",
            F.col("_below")
            + F.coalesce(
                F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    aggs = [F.max("_total").alias("n")]
    for name, p in probs.items():
        pos = position(p)
        for side, edge in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = holds(edge, F.col("_first"), F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    out = ties.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        pos = F.lit(float(p)) * (F.col("n") - 1)
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols, "n")


def grouped_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    descending: bool = True,
    method: str = "average",
    tie_break: Sequence[str] = (),
    rank: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Add the exact rank of ``value`` inside its group; null values get a null rank.

    ``method`` is "average" (ties share the mean position, a double) or "first" (positions
    1, 2, 3 .. with ties put in the order of ``tie_break``, a long). ``size`` names an optional
    column with the number of ranked rows of the group.
    """
    keys = list(keys)
    v = F.col(value)
    if method not in ("average", "first"):
        raise ValueError(f"unknown rank method {method!r}")
    cell = value_cell(v.cast("double"))
    cell = -cell if descending else cell
    data = df.withColumn("_cell", cell)
    ranked = data.filter(v.isNotNull())
    # All zeros share a cell and are equal: with a tie-break they are spread by its first characters.
    sub = F.lit("")
    if method == "first" and tie_break:
        sub = F.when(F.col("_cell") == 0, F.substring(F.col(tie_break[0]).cast("string"), 1, 4)).otherwise("")
    ranked = ranked.withColumn("_sub", F.coalesce(sub, F.lit("")))
    cells = ranked.groupBy(*keys, "_cell", "_sub").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = group.orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *keys, "_cell", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
    )
    order = v.desc() if descending else v.asc()
    if method == "average":
        # equal values are counted before they are placed, so ties never meet in one task
        values = ranked.groupBy(*keys, "_cell", "_sub", v.alias("_v")).agg(F.count("*").alias("_same"))
        inside = Window.partitionBy(*keys, "_cell").orderBy(F.col("_v").desc() if descending else F.col("_v").asc())
        lower = F.coalesce(F.sum("_same").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = values.withColumn("_lower", lower).join(cells, [*keys, "_cell", "_sub"])
        placed = placed.select(
            *keys, "_v", (F.col("_before") + F.col("_lower") + (F.col("_same") + 1) / 2).alias("_place"), "_size"
        )
        found = ranked.withColumn("_v", v).join(placed, [*keys, "_v"])
    else:
        inside = Window.partitionBy(*keys, "_cell", "_sub").orderBy(order, *tie_break)
        found = ranked.join(cells, [*keys, "_cell", "_sub"])
        found = found.withColumn("_place", (F.col("_before") + F.row_number().over(inside)).cast("long"))
    names = df.columns
    out = found.select(*names, F.col("_place").alias(rank), *([F.col("_size").alias(size)] if size else []))
    # rows without a value have no rank and are not sorted at all
    rest = data.filter(v.isNull()).select(*names)
    if size:
        sizes = cells.select(*keys, F.col("_size").alias(size)).distinct()
        rest = rest.join(sizes, keys, "left") if keys else rest.withColumn(size, sizes.agg(F.max(size)).scalar())
    return out.unionByName(rest, allowMissingColumns=True)
