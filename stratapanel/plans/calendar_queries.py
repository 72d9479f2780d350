"""Calendar and interval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import calendar as C
from stratapanel.plans import panel as P
from stratapanel.plans.registry import long, query, view


def _holidays(spark, sf):
    """Days that open a year, as present in the order table."""
    d = F.col("o_orderdate").cast("date")
    return (
        P.table(spark, sf, "orders")
        .select(d.alias("date"))
        .filter((F.month("date") == 1) & (F.dayofmonth("date") == 1))
        .distinct()
    )


@query("trading_calendar", """
WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders),
hol AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) = 1 AND day(o_orderdate) = 1),
days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT date FROM days WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM hol)""")
def trading_calendar(spark, sf):
    d = F.col("o_orderdate").cast("date")
    bounds = P.table(spark, sf, "orders").agg(F.min(d).alias("start"), F.max(d).alias("end"))
    return C.trading_calendar(bounds, _holidays(spark, sf))


@query("filter_trading_days", """
SELECT tic, date, close FROM prices WHERE date IN (SELECT date FROM calendar)""")
def filter_trading_days(spark, sf):
    p = P.prices(spark, sf).select("tic", "date", "close")
    return C.filter_trading_days(p, P.calendar(spark, sf))


view("week_ends", "SELECT max(date) AS date FROM calendar GROUP BY isoyear(date), week(date)")


@query("week_end_dates", "SELECT date FROM week_ends")
def week_end_dates(spark, sf):
    return C.week_end_dates(P.calendar(spark, sf))


def _steps(spark, sf):
    """Intervals between consecutive trades of a ticker, inside the calendar span."""
    w = Window.partitionBy("tic").orderBy("date")
    cal = P.calendar(spark, sf)
    last = cal.agg(F.max("date")).scalar()
    first = cal.agg(F.min("date")).scalar()
    p = P.prices(spark, sf).select("tic", F.lag("date").over(w).alias("start"), F.col("date").alias("end"))
    return p.filter((F.col("start") >= first) & (F.col("end") <= last))


@query("trading_days_between", """
WITH s AS (SELECT tic, lag(date) OVER (PARTITION BY tic ORDER BY date) AS a, date AS z FROM prices),
i AS (SELECT * FROM s WHERE a >= (SELECT min(date) FROM calendar) AND z <= (SELECT max(date) FROM calendar))
SELECT tic, a AS start, z AS "end", count(*) FILTER (WHERE c.date IS NOT NULL) AS both,
       count(*) FILTER (WHERE c.date < z) AS "left", count(*) FILTER (WHERE c.date > a) AS "right",
       count(*) FILTER (WHERE c.date > a AND c.date < z) AS neither
FROM i LEFT JOIN calendar c ON c.date BETWEEN a AND z GROUP BY ALL""")
def trading_days_between(spark, sf):
    return C.trading_days_between(_steps(spark, sf), P.calendar(spark, sf))


@query("nth_trading_day", """
WITH d AS (SELECT DISTINCT date FROM prices)
SELECT date, (SELECT c.date FROM calendar c WHERE c.date > d.date ORDER BY c.date LIMIT 1 OFFSET 2) AS next_3,
       (SELECT c.date FROM calendar c WHERE c.date < d.date ORDER BY c.date DESC LIMIT 1 OFFSET 1) AS prev_2
FROM d WHERE date BETWEEN (SELECT min(date) FROM calendar) AND (SELECT max(date) FROM calendar)""")
def nth_trading_day(spark, sf):
    cal = P.calendar(spark, sf)
    d = P.prices(spark, sf).select("date").distinct()
    d = d.filter(
        (F.col("date") >= cal.agg(F.min("date")).scalar())
        & (F.col("date") <= cal.agg(F.max("date")).scalar())
    )
    return C.nth_trading_day(C.nth_trading_day(d, cal, 3, "next_3"), cal, -2, "prev_2")


@query("align_to_trading_day", """
WITH d AS (SELECT DISTINCT date FROM prices WHERE date BETWEEN (SELECT min(date) FROM calendar) AND (SELECT max(date) FROM calendar)),
x AS (SELECT date, (SELECT min(c.date) FROM calendar c WHERE c.date >= d.date) AS f,
             (SELECT max(c.date) FROM calendar c WHERE c.date <= d.date) AS b FROM d)
SELECT date, f AS forward, b AS backward, CASE WHEN f - date <= date - b THEN f ELSE b END AS nearest FROM x""")
def align_to_trading_day(spark, sf):
    cal = P.calendar(spark, sf)
    d = P.prices(spark, sf).select("date").distinct()
    d = d.filter(
        (F.col("date") >= cal.agg(F.min("date")).scalar())
        & (F.col("date") <= cal.agg(F.max("date")).scalar())
    )
    for how in ("forward", "backward", "nearest"):
        d = C.align_to_trading_day(d, cal, how, how)
    return d


@query("missing_trading_days", """
WITH t AS (SELECT 'S' || s_suppkey AS tic, DATE '1995-01-02' + CAST(s_suppkey % 365 AS INTEGER) AS first_added FROM supplier)
SELECT t.tic, c.date FROM t JOIN calendar c ON c.date >= t.first_added
WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.tic = t.tic AND p.date = c.date)""")
def missing_trading_days(spark, sf):
    tickers = P.table(spark, sf, "supplier").select(
        P.ticker("s_suppkey").alias("tic"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("first_added"),
    )
    return C.missing_trading_days(tickers, P.prices(spark, sf).select("tic", "date"), P.calendar(spark, sf))


@query("consolidate_date_ranges", """
WITH d AS (SELECT tic, date, date - CAST(row_number() OVER (PARTITION BY tic ORDER BY date) AS INTEGER) AS island
           FROM prices)
SELECT tic, min(date) AS start, max(date) AS "end", count(*) AS days FROM d GROUP BY tic, island""")
def consolidate_date_ranges(spark, sf):
    return C.consolidate_date_ranges(P.prices(spark, sf), ["tic"])


def _log(spark, sf):
    """Interval log: each event opens a range of 0 to 4 days for its user and hour of the day."""
    day = F.col("ts").cast("date")
    return P.table(spark, sf, "events").select(
        (F.col("user_id") * 24 + F.hour("ts")).alias("user_id"),
        day.alias("start"),
        F.date_add(day, (F.floor("value") % 5).cast("int")).alias("end"),
    )


view("fetch_log", """
SELECT user_id * 24 + hour(ts) AS user_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(floor(value) % 5 AS INTEGER) AS z
FROM events""")
view("merged_log", """
SELECT user_id, min(a) AS a, max(z) AS z FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                   THEN 0 ELSE 1 END AS fresh FROM fetch_log) q1) q2
GROUP BY user_id, island""")


@query("merge_intervals", 'SELECT user_id, a AS start, z AS "end" FROM merged_log')
def merge_intervals(spark, sf):
    return C.merge_intervals(_log(spark, sf), ["user_id"])


@query("interval_gaps", """
WITH req AS (SELECT DISTINCT user_id, DATE '2024-01-03' + CAST(user_id % 7 AS INTEGER) AS rs, DATE '2024-02-05' AS re FROM fetch_log),
days AS (SELECT user_id, CAST(unnest(generate_series(rs, re, INTERVAL 1 DAY)) AS DATE) AS d FROM req),
open AS (SELECT user_id, d FROM days WHERE NOT EXISTS
  (SELECT 1 FROM fetch_log l WHERE l.user_id = days.user_id AND days.d BETWEEN l.a AND l.z)),
isl AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM open)
SELECT user_id, min(d) AS start, max(d) AS "end" FROM isl GROUP BY user_id, g""")
def interval_gaps(spark, sf):
    log = _log(spark, sf)
    req = log.select("user_id").distinct().select(
        "user_id",
        F.date_add(F.lit("2024-01-03").cast("date"), (F.col("user_id") % 7).cast("int")).alias("start"),
        F.lit("2024-02-05").cast("date").alias("end"),
    )
    return C.interval_gaps(req, log, ["user_id"])


@query("month_end_rebalance_dates", """
SELECT date FROM week_ends WHERE last_day(date) = date OR month(date + 7) <> month(date)""")
def month_end_rebalance_dates(spark, sf):
    return C.month_end_rebalance_dates(P.calendar(spark, sf))


@query("rebalance_day_flag", """
WITH x AS (SELECT date, row_number() OVER (PARTITION BY year(date), week(date) ORDER BY date) AS wk,
       row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) AS mo,
       count(*) OVER (PARTITION BY year(date), month(date)) AS sz FROM calendar)
SELECT date, true AS daily, wk = 1 AS weekly, mo = sz OR mo = 2 OR sz = 1 AS monthly FROM x""")
def rebalance_day_flag(spark, sf):
    return C.rebalance_day_flag(P.calendar(spark, sf))


def _order_days(spark, sf):
    return P.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


@query("datadate_to_tradedate", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, CASE WHEN last_day(date) = date AND month(date) % 3 = 0
                  THEN CAST(date_trunc('month', date) + INTERVAL 3 MONTH AS DATE) END AS tradedate FROM d""")
def datadate_to_tradedate(spark, sf):
    return _order_days(spark, sf).withColumn("tradedate", C.datadate_to_tradedate(F.col("date")))


@query("quarter_align_mjsd", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, CASE WHEN month(date) IN (1, 2) THEN make_date(year(date), 3, 1)
                  WHEN month(date) IN (3, 4, 5) THEN make_date(year(date), 6, 1)
                  WHEN month(date) IN (6, 7, 8) THEN make_date(year(date), 9, 1)
                  WHEN month(date) IN (9, 10, 11) THEN make_date(year(date), 12, 1)
                  ELSE make_date(year(date) + 1, 3, 1) END AS aligned FROM d""")
def quarter_align_mjsd(spark, sf):
    return _order_days(spark, sf).withColumn("aligned", C.quarter_align_mjsd(F.col("date")))


@query("statement_quarter_key", """
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d,
     CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y,
     CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'fy' ELSE 'q' || substr(o_orderpriority, 1, 1) END AS p FROM orders),
k AS (SELECT *, CASE WHEN y IS NOT NULL THEN last_day(make_date(y, CASE p WHEN 'q1' THEN 3 WHEN 'q2' THEN 6 WHEN 'q3' THEN 9 ELSE 12 END, 1))
      ELSE last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) END AS quarter_key FROM s)
SELECT o_custkey, quarter_key, max_by(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS statement FROM k GROUP BY 1, 2""")
def statement_quarter_key(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    s = P.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice",
        C.statement_quarter_key(
            F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")),
            F.when(first == "5", "fy").otherwise(F.concat(F.lit("q"), first)),
            F.col("o_orderdate").cast("date"),
        ).alias("quarter_key"),
    )
    return s.groupBy("o_custkey", "quarter_key").agg(
        F.max_by("o_totalprice", "o_orderkey").alias("value"), F.max("o_orderkey").alias("statement")
    )


@query("effective_trade_cutoff", """
WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders),
q AS (SELECT DISTINCT datadate FROM quarter_closes)
SELECT as_of, coalesce((SELECT max(datadate) FROM q WHERE datadate < date_trunc('quarter', as_of) - INTERVAL 3 MONTH),
                       (SELECT min(datadate) FROM q)) AS cutoff FROM a""")
def effective_trade_cutoff(spark, sf):
    as_of = _order_days(spark, sf).withColumnRenamed("date", "as_of")
    return C.effective_trade_cutoff(as_of, P.quarter_closes(spark, sf).select("datadate").distinct())


@query("actual_trade_date", """
WITH t AS (SELECT DISTINCT CAST(date_trunc('month', datadate) + INTERVAL 3 MONTH AS DATE) AS tradedate FROM quarter_closes)
SELECT tradedate, coalesce((SELECT min(date) FROM calendar WHERE date >= tradedate AND date <= tradedate + 10), tradedate) AS actual
FROM t""")
def actual_trade_date(spark, sf):
    t = P.quarter_closes(spark, sf).select("datadate").distinct()
    t = t.select(C.datadate_to_tradedate(F.col("datadate")).alias("tradedate"))
    return C.actual_trade_date(t, P.calendar(spark, sf), "tradedate", "actual")
