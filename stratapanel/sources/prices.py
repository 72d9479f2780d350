"""Price sources, stores and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.sources.scratch import few_listings

CSV_SCHEMA = "date date, open double, high double, low double, close double, volume double"

# Provider column names and the names used here.
PROVIDER_COLUMNS = {
    "tic": "tic",
    "datadate": "date",
    "prcod": "open",
    "prchd": "high",
    "prcld": "low",
    "prccd": "close",
    "cshtrd": "volume",
}
PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")


def price_csv_scan(
    spark: SparkSession,
    folder: str,
    start: str | None = None,
    end: str | None = None,
    symbols: Sequence[str] | None = None,
    required: bool = True,
) -> DataFrame:
    """One CSV file (or folder) ``{SYM}_daily.csv`` per symbol, symbol taken from the path.

    A row with any negative price loses every value. A header that lacks a column is an error,
    because the schema is enforced against it, and so is a symbol without a file; unless
    ``required``, such symbols are left out as long as one is there.
    """
    paths = [f"{folder}/{s}_daily.csv" for s in symbols] if symbols else [f"{folder}/*_daily.csv"]
    if symbols and not required:
        paths = [f"{folder}/{{{','.join(symbols)}}}_daily.csv"]
    reader = spark.read.schema(CSV_SCHEMA).option("header", True).option("enforceSchema", False)
    with few_listings(spark):
        raw = reader.option("ignoreCorruptFiles", not required).csv(paths)
    raw = raw.withColumn("tic", F.regexp_extract("_metadata.file_path", r"([^/=]+)_daily\.csv", 1))
    if start is not None:
        raw = raw.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        raw = raw.filter(F.col("date") <= F.lit(end).cast("date"))
    bad = F.least("open", "high", "low", "close") < 0
    cols = ("open", "high", "low", "close", "volume")
    return raw.select("tic", "date", *(F.when(~F.coalesce(bad, F.lit(False)), F.col(c)).alias(c) for c in cols))


def price_csv_scan_mapped(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    schema: str,
    start: str | None = None,
    end: str | None = None,
    tickers: Sequence[str] | None = None,
) -> DataFrame:
    """CSV files with foreign column names: ``columns`` maps our name to the file's name."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = raw.select(*(F.col(theirs).alias(ours) for ours, theirs in columns.items()))
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    if tickers is not None:
        df = df.filter(F.col("tic").isin(list(tickers)))
    return df


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write wins per key, ``seq`` ordering writes inside ``incoming``.

    Columns the incoming side does not carry keep their stored value. Each key keeps one row by an
    aggregate with map-side combine, so repeated writes of a hot key never sit in one task.
    """
    keys = list(keys)
    new_cols = [c for c in incoming.columns if c not in keys and c != seq]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*new_cols), seq).alias("_new"))
    joined = existing.join(last, keys, "full")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in new_cols:
            out.append(
                F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            )
        else:
            out.append(F.col(c))
    return joined.select(*out)


def from_provider(df: DataFrame) -> DataFrame:
    """Provider frame to the stored price layout; missing value columns become null."""
    have = set(df.columns)
    names = {t: o for t, o in PROVIDER_COLUMNS.items() if t in have and (o == t or o not in have)}
    df = df.withColumnsRenamed(names)
    have = set(df.columns)
    if "tic" not in have:
        df = df.withColumn("tic", F.col("gvkey") if "gvkey" in have else F.lit("UNKNOWN"))
    for c in PRICE_COLUMNS:
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return df


def price_upsert(stored: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """Write a provider price frame into the stored prices, key (tic, date)."""
    new = from_provider(incoming).select("tic", "date", *PRICE_COLUMNS, seq)
    return upsert(stored, new, ["tic", "date"], seq)


def price_range_scan(
    stored: DataFrame, tickers: Sequence[str] | DataFrame, start: str, end: str, ordered: bool = True
) -> DataFrame:
    """Inclusive date range of some tickers, in provider names, sorted by (tic, date)."""
    d = F.col("date")
    df = stored.filter(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if isinstance(tickers, DataFrame):
        df = df.join(tickers.select("tic").distinct(), "tic", "left_semi")
    else:
        df = df.filter(F.col("tic").isin(list(tickers)))
    back = {o: t for t, o in PROVIDER_COLUMNS.items() if o != t}
    df = df.withColumnsRenamed(back).withColumn("gvkey", F.col("tic"))
    return df.orderBy("tic", "datadate") if ordered else df


def _first_of(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return default


def standardise_prices(df: DataFrame) -> DataFrame:
    """Any provider's daily frame to one layout, with defaults for missing columns."""
    tic = _first_of(df, ("tic", "gvkey"), F.lit("UNKNOWN"))
    close = _first_of(df, ("prccd", "Close", "close"), F.lit(100.0))
    cols = {
        "gvkey": _first_of(df, ("gvkey", "tic"), F.lit("UNKNOWN")),
        "datadate": _first_of(df, ("datadate", "date"), F.lit(None).cast("date")),
        "tic": tic,
        "prccd": close,
        "prcod": _first_of(df, ("prcod", "Open", "open"), close),
        "prchd": _first_of(df, ("prchd", "High", "high"), close),
        "prcld": _first_of(df, ("prcld", "Low", "low"), close),
        "cshtrd": _first_of(df, ("cshtrd", "Volume", "volume"), F.lit(1000000.0)),
        "adj_close": _first_of(df, ("adj_close", "Adj Close"), close),
    }
    return df.select(*(c.alias(n) for n, c in cols.items()))


def standardise_fundamentals(df: DataFrame) -> DataFrame:
    """Keys, price and adjustment factor of a fundamentals frame, with defaults."""
    price = _first_of(df, ("prccd", "close", "adj_close"), F.lit(100.0))
    factor = _first_of(df, ("ajexdi", "adj_factor"), F.lit(1.0))
    return df.select(
        _first_of(df, ("gvkey", "tic"), F.lit("UNKNOWN")).alias("gvkey"),
        _first_of(df, ("datadate", "date"), F.lit(None).cast("date")).alias("datadate"),
        _first_of(df, ("tic", "gvkey"), F.lit("UNKNOWN")).alias("tic"),
        price.alias("prccd"),
        factor.alias("ajexdi"),
        _first_of(df, ("adj_close",), F.try_divide(price, factor)).alias("adj_close"),
    )
