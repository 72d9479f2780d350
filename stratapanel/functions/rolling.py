"""Row-frame helpers.

A frame here is always inside one ticker (or one series). Ticker partitions hold at most one row
per calendar day, so their size is bounded by the calendar and not by the volume of raw trades.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(*keys: str, order: str = "date") -> WindowSpec:
    """Ordered window over the keys."""
    return Window.partitionBy(*keys).orderBy(order)


def whole(order: str = "date") -> WindowSpec:
    """Ordered window over a whole table, for calendar-sized tables only (a row per day at most)."""
    return Window.partitionBy(F.lit(1)).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """Frame of the current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def upto(w: WindowSpec) -> WindowSpec:
    """Frame from the first row to the current one."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, agg: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate that is null until the frame holds n non-null values."""
    frame = last_rows(w, n)
    return F.when(F.count(value).over(frame) == n, agg.over(frame))


def rolling_mean(value: Column, w: WindowSpec, n: int) -> Column:
    return full(value, F.avg(value), w, n)


def rolling_std(value: Column, w: WindowSpec, n: int) -> Column:
    return full(value, F.stddev_samp(value), w, n)


def rolling_median(value: Column, w: WindowSpec, n: int) -> Column:
    return full(value, F.percentile(value, F.lit(0.5)), w, n)


def with_last_moments(
    df: DataFrame, value: str, name: str, n: int, key: str = "tic", order: str = "date"
) -> DataFrame:
    """Add a struct of the last n rows' moments: values ``n``, ``total``, squares about the mean, ``low``, ``high``.

    For long frames: the work of a row does not grow with n. A key's rows are cut into blocks of n; a frame is the
    beginning of one block and the end of the block before, each from a running window, put together as partial
    variances are. Nothing is subtracted, so a large value does no harm to the frames without it.
    """
    d = df.withColumn("_place", F.row_number().over(by(key, order=order)) - 1)
    d = d.withColumn("_block", F.floor(F.col("_place") / n))
    v = F.col(value).cast("double")

    def running(way: Column) -> Column:
        w = upto(Window.partitionBy(key, "_block").orderBy(way))
        count = F.count(v).over(w)
        return F.struct(
            count.alias("n"), F.coalesce(F.sum(v).over(w), F.lit(0.0)).alias("total"),
            F.coalesce(F.var_pop(v).over(w) * count, F.lit(0.0)).alias("squares"),
            F.min(v).over(w).alias("low"), F.max(v).over(w).alias("high"),
        )

    d = d.withColumn("_end", running(F.col("_place").desc())).withColumn("_begin", running(F.col("_place")))
    # the block's last row has its whole frame in the block
    before = F.when(F.col("_place") % n != n - 1, F.lag("_end", n - 1).over(Window.partitionBy(key).orderBy("_block", "_place")))
    d = d.withColumn("_end", before)

    def joined(a: Column, b: Column) -> Column:
        gap = b["total"] / b["n"] - a["total"] / a["n"]
        return F.when(a.isNull() | (a["n"] == 0), b).when(b["n"] == 0, a).otherwise(F.struct(
            (a["n"] + b["n"]).alias("n"), (a["total"] + b["total"]).alias("total"),
            (a["squares"] + b["squares"] + gap * gap * (a["n"] * b["n"] / (a["n"] + b["n"]))).alias("squares"),
            F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
        ))

    return d.withColumn(name, joined(F.col("_end"), F.col("_begin"))).drop("_place", "_block", "_end", "_begin")


def change(value: Column, w: WindowSpec, n: int = 1) -> Column:
    """Relative change against the value n rows back; null on the first rows and on zero."""
    return F.try_divide(value, F.lag(value, n).over(w)) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once per row and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _middle(values: Column) -> Column:
    n = F.size(values)
    low = F.floor((n - 1) / F.lit(2)).cast("int")
    high = F.floor(n / F.lit(2)).cast("int")
    return F.when(n > 0, (F.get(values, low) + F.get(values, high)) / 2)


def array_median(values: Column) -> Column:
    """Exact median of an array of doubles; null for an empty array."""
    return let(F.array_sort(values), _middle)


def array_mad(values: Column, center: Column) -> Column:
    """Median absolute deviation of an array around a centre."""
    return array_median(F.transform(values, lambda x: F.abs(x - center)))
