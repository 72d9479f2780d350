"""User-supplied functions: the places where a caller's own code plugs in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratapanel.functions import rolling as R

Strategy = Callable[..., DataFrame]


def signal_per_ticker(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a function on each ticker's rows in date order; it returns rows of ``schema``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return func(pdf.sort_values("date"))

    return df.groupBy("tic").applyInPandas(one, schema)


def window_function(
    df: DataFrame, value: str, n: int, func: Callable, name: str, many: bool = False
) -> DataFrame:
    """A function over the last n values of each row, null until n are there.

    ``func`` takes a series of n values and gives a number. With ``many`` it takes a frame with a window in each column and
    gives a number for each, as pandas reductions do: a ticker's windows are then one call and not one for each row.
    """
    if not many:
        @F.pandas_udf("double")
        def udf(s: pd.Series) -> float:
            return float(func(s))

        frame = R.last_rows(R.by("tic"), n)
        return df.withColumn(name, F.when(F.count(value).over(frame) == n, udf(F.col(value)).over(frame)))
    made = f"_{name}_made"

    def one(rows: pa.Table) -> pa.Table:
        # rows stay Arrow, so the other columns keep their types and nulls
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("date", "ascending")], null_placement="at_start"))
        values, known = rows[value].to_pandas().to_numpy(), rows[value].is_valid().to_numpy()
        seen = np.concatenate(([0], np.cumsum(known)))
        full = np.flatnonzero(seen[n:] - seen[:-n] == n)
        out = np.full(len(values), np.nan)
        if len(full):
            windows = np.lib.stride_tricks.sliding_window_view(values, n)[full]
            out[full + n - 1] = np.asarray(func(pd.DataFrame(windows.T)), dtype=float).reshape(len(full))
        return rows.append_column(made, pa.array(out, from_pandas=True))

    schema = StructType([*df.schema, StructField(made, DoubleType())])
    return df.groupBy("tic").applyInArrow(one, schema).withColumn(name, F.col(made)).drop(made)


def run_strategy(strategy: Strategy, *args, **kw) -> DataFrame:
    """Call a strategy and hold it to the one contract between stages: (date, tic, weight)."""
    out = strategy(*args, **kw)
    missing = {"date", "tic", "weight"} - set(out.columns)
    if missing:
        raise ValueError(f"a strategy must return {sorted(missing)}")
    return out.select("date", "tic", F.col("weight").cast("double").alias("weight"))


CostFunction = Callable[[Column, Column, Column], Column]
