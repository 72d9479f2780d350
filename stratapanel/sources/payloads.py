"""Raw provider payloads, news, membership snapshots and store statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def raw_payload_store(
    df: DataFrame,
    source: str,
    payload: str,
    ticker: Column,
    date: str,
    seq: str,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Payload rows as JSON, one per (source, payload, ticker, date), the last by ``seq``.

    ``date`` names the payload's date column, which its declared schema says. Rows whose date does not parse or lies outside the range are dropped.
    """
    body = [c for c in df.columns if c != seq]
    day = F.try_to_date(F.col(date).cast("string"))
    rows = df.select(
        ticker.alias("ticker"), day.alias("date"), F.col(seq).alias("_seq"),
        F.to_json(F.struct(*(F.date_format(day, "yyyy-MM-dd").alias(c) if c == date else F.col(c) for c in body))).alias("row_json"),
    ).filter(F.col("date").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy(F.coalesce("ticker", F.lit("bulk")).alias("ticker"), "date").agg(
        F.max_by("row_json", "_seq").alias("row_json")
    ).select(F.lit(source).alias("source"), F.lit(payload).alias("payload"), "ticker", "date", "row_json")


def raw_payload_scan(
    store: DataFrame, source: str, payload: str, schema: str, start: str, end: str
) -> DataFrame:
    """Decoded payload rows of a date range; text that is no JSON object is skipped."""
    rows = store.filter(
        (F.col("source") == source)
        & (F.col("payload") == payload)
        & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    marked = f"{schema}, _bad string"
    parsed = F.from_json("row_json", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("row", parsed).filter(F.col("row").isNotNull() & F.col("row._bad").isNull())
    return out.select("ticker", "date", F.col("row").dropFields("_bad").alias("row"))


def raw_payload_latest_date(store: DataFrame, source: str, payload: str) -> DataFrame:
    """Newest stored date per ticker."""
    rows = store.filter((F.col("source") == source) & (F.col("payload") == payload))
    return rows.groupBy("ticker").agg(F.max("date").alias("latest"))


def news_rows(df: DataFrame) -> DataFrame:
    """Articles to stored news rows: body is text, else body, else empty; date from the time."""
    have = set(df.columns)
    opts = [F.nullif(F.col(c), F.lit("")) for c in ("text", "body") if c in have]
    return df.withColumn("body", F.coalesce(*opts, F.lit(""))).withColumn(
        "published_date", F.to_date("published_datetime")
    )


def index_snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Comma-joined parallel lists (tickers, sectors, date_first_added) to one row per member."""

    def parts(c: str) -> Column:
        return F.split(F.col(c), ",")

    zipped = F.arrays_zip(
        parts("tickers").alias("tic"),
        parts("sectors").alias("sector"),
        parts("date_first_added").alias("first_added"),
    )
    return snapshots.select("date", F.explode(zipped).alias("m")).select(
        "date",
        F.trim("m.tic").alias("tic"),
        F.trim("m.sector").alias("sector"),
        F.try_to_date(F.trim("m.first_added")).alias("first_added"),
    )


def index_snapshot(snapshots: DataFrame, date: str | None = None) -> DataFrame:
    """Members at one snapshot date, the latest when none is given."""
    if date is not None:
        return index_snapshot_rows(snapshots.filter(F.col("date") == F.lit(date).cast("date")))
    return index_snapshot_rows(
        snapshots.filter(F.col("date") == snapshots.agg(F.max("date")).scalar())
    )


def storage_stats(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Row count and bytes on disk of each stored parquet table."""
    parts = []
    for name, path in tables.items():
        files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
        per_file = files.groupBy("file_path").agg(
            F.count("*").alias("rows"), F.first("file_size").alias("bytes")
        )
        parts.append(
            per_file.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).withColumn(
                "name", F.lit(name)
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
