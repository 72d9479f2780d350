"""Partitioned outputs and the wide weights export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.sources.scratch import cut_lineage


def sector_split_sink(df: DataFrame, path: str, sector: str) -> None:
    """One output folder per sector. Spark splits big sectors over as many tasks as their bytes ask for."""
    df.hint("rebalance", sector).write.partitionBy(sector).parquet(path)


def prediction_sinks(df: DataFrame, path: str, tag: str, formats: Sequence[str] = ("parquet",)) -> None:
    """Write a result table once per format, one folder per trade tag.

    The result is computed once: the first format is written from ``df``, the others from a
    written table.
    """
    if len(formats) > 1:
        df = cut_lineage(df, "predictions")
    df = df.hint("rebalance", tag)
    for fmt in formats:
        out = df.write.partitionBy(tag).mode("append").format(fmt)
        (out.option("header", True) if fmt == "csv" else out).save(f"{path}/{fmt}")


def weights_wide_export(weights: DataFrame, by_date: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """One row per date, one column per symbol (0 where not held), cash and regime.

    The symbols are the file's columns, hence part of the plan, and named by the caller; weights of other
    symbols are not in the file.
    """
    wide = weights.groupBy("date").pivot("symbol", list(symbols)).agg(F.sum("weight"))
    return by_date.join(wide, "date", "left").na.fill(0.0, subset=list(symbols))
