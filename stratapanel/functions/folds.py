"""Ordered folds inside the JVM: a key's rows in order, a state that goes from row to row, a row out for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_rows(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], zero: Column,
    step: Callable[[Column, Column], tuple[Column, Column]], out: str,
) -> DataFrame:
    """Fold each key's rows in ``order`` and return what every step puts out, beside the keys.

    ``zero`` is the first state, a struct; ``step(state, row)`` gives the next state, of the same type, and the
    output, a struct with the fields that ``out`` declares. A key's rows are gathered in one array, so keys
    must be bounded: a ticker or a parameter set with a row for each day is.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *(v for v in values if v != order))))
    start = F.struct(zero.alias("state"), F.array().cast(f"array<struct<{out}>>").alias("out"))

    def merge(done: Column, row: Column) -> Column:
        state, made = step(done["state"], row)
        return F.struct(state.alias("state"), F.concat(done["out"], F.array(made)).alias("out"))

    gathered = df.groupBy(*keys).agg(rows.alias("_rows"))
    folded = F.aggregate("_rows", start, merge, lambda done: done["out"])
    return gathered.select(*keys, F.explode(folded).alias("_out")).select(*keys, "_out.*")
