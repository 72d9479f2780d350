"""Derived panel: the research tables every query starts from, built from the given tables.

Every supplier is a ticker. Prices are cut to cents, so sums of prices are exact integers of
cents and do not depend on the order of additions. Each table has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.plans.registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticker(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One row per raw trade: tic, date, price in cents, quantity and an order key."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        ticker("l_suppkey").alias("tic"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.floor(p * 100) / 100).alias("p"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_orderkey") * 1000000 + F.floor(p * 100) / 100).alias("k"),
    )


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).groupBy("tic", "date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def smooth(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """Calm price level per ticker: mean close of the last n rows."""
    frame = Window.partitionBy("tic").orderBy("date").rowsBetween(-(n - 1), 0)
    cents = F.round(F.col("close") * 100).cast("long")
    return prices(spark, sf).select(
        "tic",
        "date",
        (F.sum(cents).over(frame) / F.count("*").over(frame) / 100).alias("close"),
        "volume",
    )


def bench(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """Benchmark level per date: mean calm price over all tickers, from the smoothed panel if given."""
    cents = F.floor(F.col("close") * 100)
    return (smooth(spark, sf) if daily is None else daily).groupBy("date").agg(
        (F.sum(cents) / F.count("*") / 100).alias("close")
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days: weekdays with an order. At most one row per day, so it is kept in memory and
    the many lookups of a plan do not scan the orders again."""
    d = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf, "orders")
        .select(d.alias("date"))
        .filter(F.weekday("date") < 5)
        .distinct()
        .cache()
    )


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(ticker("s_suppkey").alias("tic"), F.col("r_name").alias("sector"))
    )


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly sums per ticker, money in whole cents before summing."""
    money = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    net = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.3)
    gross = F.floor(
        F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100 + 0.3
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            ticker("l_suppkey").alias("tic"),
            F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("quarter_start"),
        )
        .agg(
            (F.sum(money) / 100).alias("revenue"),
            (F.sum(net) / 100).alias("net_revenue"),
            (F.sum(gross) / 100).alias("gross"),
            F.sum("l_quantity").alias("shares"),
            F.count("*").alias("n"),
        )
    )


def quarter_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Last calm price of each ticker and quarter, dated at the quarter end."""
    return (
        smooth(spark, sf)
        .groupBy("tic", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("datadate"))
        .agg(F.max_by("close", "date").alias("price"))
    )


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly snapshots: the tickers with at least the month's mean turnover."""
    money = F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    totals = (
        table(spark, sf, "lineitem")
        .groupBy(month.alias("snap_date"), ticker("l_suppkey").alias("tic"))
        .agg(money.alias("turnover"))
    )
    level = totals.groupBy("snap_date").agg(F.sum("turnover").alias("total"), F.count("*").alias("tickers"))
    return (
        totals.join(level, "snap_date").filter(F.col("turnover") * F.col("tickers") >= F.col("total"))
        .select("snap_date", "tic")
    )


def equal_membership_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Equal weights over each monthly snapshot (date, tic, weight)."""
    m = membership(spark, sf)
    n = m.groupBy("snap_date").agg(F.count("*").alias("n"))
    return m.join(n, "snap_date").select(
        F.col("snap_date").alias("date"), "tic", (1 / F.col("n")).alias("weight")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly predictions (a fixed formula of the factors) with the realised label."""
    w = Window.partitionBy("tic").orderBy("datadate")
    f = fundamentals(spark, sf).select(
        "tic",
        F.last_day(F.add_months("quarter_start", 2)).alias("datadate"),
        "revenue", "net_revenue", "gross", "shares", "n",
    )
    return (
        f.join(quarter_closes(spark, sf), ["tic", "datadate"])
        .join(sectors(spark, sf), "tic")
        .select(
            "tic", "datadate", "sector", "price", "revenue", "net_revenue", "gross", "shares", "n",
            F.ln(F.lead("price").over(w) / F.col("price")).alias("y_return"),
            (F.col("net_revenue") / F.col("revenue") - 0.95).alias("pred"),
            (F.col("gross") / F.col("net_revenue") - 1.04).alias("pred2"),
        )
    )


# ---------------------------------------------------------------- SQL twins (DuckDB dialect)
view("trades", """
SELECT 'S' || l_suppkey AS tic, CAST(l_shipdate AS DATE) AS date,
       floor(l_extendedprice / l_quantity * 100) / 100 AS p, l_quantity AS quantity,
       l_orderkey * 1000000 + floor(l_extendedprice / l_quantity * 100) / 100 AS k
FROM lineitem""")
view("prices", """
SELECT tic, date, min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close,
       sum(quantity) AS volume
FROM trades GROUP BY 1, 2""")
view("smooth", """
SELECT tic, date, CAST(sum(CAST(round(close * 100) AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w / 100 AS close, volume
FROM prices WINDOW w AS (PARTITION BY tic ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
view("bench", """
SELECT date, CAST(sum(CAST(floor(close * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close
FROM smooth GROUP BY 1""")
view("calendar", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6""")
view("sectors", """
SELECT 'S' || s_suppkey AS tic, r_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("fundamentals", """
SELECT 'S' || l_suppkey AS tic, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter_start,
       CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
       CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.3) AS BIGINT)) AS DOUBLE) / 100 AS net_revenue,
       CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.3) AS BIGINT)) AS DOUBLE) / 100 AS gross,
       sum(l_quantity) AS shares, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
view("quarter_closes", """
SELECT tic, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS datadate,
       max_by(close, date) AS price
FROM smooth GROUP BY 1, 2""")
view("membership", """
SELECT snap_date, tic FROM (
  SELECT *, sum(turnover) OVER (PARTITION BY snap_date) AS total, count(*) OVER (PARTITION BY snap_date) AS tickers FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snap_date, 'S' || l_suppkey AS tic,
           sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS turnover
    FROM lineitem GROUP BY 1, 2) t) x
WHERE turnover * tickers >= total""")
view("equal_weights", """
SELECT snap_date AS date, tic, 1.0::DOUBLE / count(*) OVER (PARTITION BY snap_date) AS weight FROM membership""")
view("predictions", """
SELECT tic, datadate, sector, price, revenue, net_revenue, gross, shares, n,
       ln(lead(price) OVER (PARTITION BY tic ORDER BY datadate) / price) AS y_return,
       net_revenue / revenue - 0.95::DOUBLE AS pred, gross / net_revenue - 1.04::DOUBLE AS pred2
FROM (SELECT tic, last_day(CAST(quarter_start + INTERVAL 2 MONTH AS DATE)) AS datadate,
             revenue, net_revenue, gross, shares, n FROM fundamentals) f
JOIN quarter_closes USING (tic, datadate) JOIN sectors USING (tic)""")
