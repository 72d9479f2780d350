"""As-of, membership and expansion join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import features as W
from stratapanel.operators import joins as J
from stratapanel.plans import panel as P
from stratapanel.plans.cleaning_queries import day_returns
from stratapanel.plans.feature_queries import bench_returns
from stratapanel.plans.registry import cut, qcut, query, view
from stratapanel.sources import scratch


@query("asof_join_backward", f"""
WITH p AS (SELECT tic, date, lead(close, 63) OVER (PARTITION BY tic ORDER BY date) / close - 1 AS fr FROM prices)
SELECT f.tic, f.datadate, f.revenue, {qcut('p.fr')} AS future_return
FROM predictions f ASOF JOIN p ON f.tic = p.tic AND f.datadate >= p.date WHERE p.fr IS NOT NULL""")
def asof_join_backward(spark, sf):
    p = P.prices(spark, sf).select("tic", "date", W.future_return_label(F.col("close")).alias("future_return"))
    # A null label still is the nearest row, so it must win over older labels.
    p = p.withColumn("future_return", F.coalesce("future_return", F.lit(float("inf"))))
    d = J.asof_features(P.predictions(spark, sf).select("tic", "datadate", "revenue"), p, "future_return")
    return d.withColumn("future_return", cut(F.col("future_return")))


view("tradedates", """
SELECT tic, datadate, CAST(date_trunc('month', datadate) + INTERVAL 3 MONTH AS DATE) AS td, n FROM predictions""")


@query("pit_membership", """
WITH r AS (SELECT tic, CASE WHEN n % 10 = 0 THEN 'latest' WHEN n % 10 = 1 THEN 'mixed' WHEN n % 10 = 2 THEN strftime(datadate - 3, '%Y-%m-%d') ELSE strftime(datadate, '%Y-%m-%d') END AS datadate,
           CASE WHEN n % 10 > 2 THEN td END AS td, n FROM tradedates)
SELECT tic, datadate, n FROM r WHERE datadate IN ('latest', 'mixed') OR EXISTS (
  SELECT 1 FROM membership m WHERE m.tic = r.tic AND m.snap_date = (SELECT max(snap_date) FROM membership s WHERE s.snap_date <= r.td))""")
def pit_membership(spark, sf):
    k = F.col("n") % 10
    day = F.when(k == 2, F.date_sub("datadate", 3)).otherwise(F.col("datadate"))
    rows = P.predictions(spark, sf).select(
        "tic", F.when(k == 0, "latest").when(k == 1, "mixed").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("datadate"), "n"
    )
    return J.pit_membership(rows, P.membership(spark, sf))


def _lists(spark, sf):
    """Membership lists dated at month ends."""
    m = P.membership(spark, sf).groupBy(F.last_day("snap_date").alias("date"))
    return m.agg(F.concat_ws(", ", F.array_sort(F.collect_list("tic"))).alias("tickers"))


view("expected_pairs", """
SELECT DISTINCT q AS quarter_end, tic FROM (SELECT DISTINCT last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS q FROM
   (SELECT last_day(snap_date) AS date FROM membership UNION ALL SELECT last_day(CAST(snap_date + INTERVAL 3 MONTH AS DATE)) FROM membership) s) e
JOIN membership ON last_day(snap_date) >= q - INTERVAL 3 MONTH AND last_day(snap_date) <= q""")


@query("members_in_quarter", """
SELECT quarter_end, tic, tic IN (SELECT tic FROM membership WHERE snap_date >= DATE '2001-01-01') AS recent FROM expected_pairs""")
def members_in_quarter(spark, sf):
    lists = _lists(spark, sf)
    recent = J.all_members(lists, "2001-01-01").withColumn("recent", F.lit(True))
    return J.members_in_quarter(lists).join(recent, "tic", "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


def _stored(spark, sf):
    q = P.quarter_closes(spark, sf).filter(F.col("price") > 6000)
    return q.select("tic", F.col("datadate").alias("quarter_end"))


@query("missing_pairs_anti", f"""
WITH s AS (SELECT tic, datadate AS quarter_end FROM quarter_closes WHERE price > 6000),
c AS (SELECT e.quarter_end, count(*) AS expected, coalesce(max(n), 0) AS stored FROM expected_pairs e LEFT JOIN (SELECT quarter_end, count(DISTINCT tic) AS n FROM s GROUP BY 1) t USING (quarter_end) GROUP BY 1)
SELECT e.tic, e.quarter_end, c.expected, c.stored, {qcut('c.stored * 100.0::DOUBLE / c.expected')} AS coverage
FROM expected_pairs e JOIN c USING (quarter_end) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tic = e.tic AND s.quarter_end = e.quarter_end)""")
def missing_pairs_anti(spark, sf):
    e = J.members_in_quarter(_lists(spark, sf))
    s = _stored(spark, sf)
    d = J.missing_pairs(e, s).join(J.quarter_coverage(e, s), "quarter_end")
    return d.withColumn("coverage", cut(F.col("coverage")))


def _order_rows(spark, sf):
    """Every order of every line as a dated row that asks for a price of its ticker."""
    o = P.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("asked"))
    li = P.table(spark, sf, "lineitem").select("l_orderkey", P.ticker("l_suppkey").alias("tic"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "tic", "asked")


view("order_rows", """
SELECT o_orderkey, 'S' || l_suppkey AS tic, CAST(o_orderdate AS DATE) AS asked FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


@query("price_on_or_after", """
WITH q AS (SELECT DISTINCT tic, asked FROM order_rows),
f AS (SELECT q.tic, q.asked, p.date AS fd, p.close AS fp FROM q ASOF LEFT JOIN prices p ON q.tic = p.tic AND q.asked <= p.date),
b AS (SELECT q.tic, q.asked, p.close AS bp FROM q ASOF LEFT JOIN prices p ON q.tic = p.tic AND q.asked >= p.date)
SELECT o_orderkey, tic, asked, coalesce(fp, bp) AS price, coalesce(CASE WHEN fd - asked <= 3 THEN fp END, bp) AS price_near
FROM order_rows JOIN f USING (tic, asked) JOIN b USING (tic, asked)""")
def price_on_or_after(spark, sf):
    p = P.prices(spark, sf).select("tic", "date", "close")
    d = J.price_on_or_after(_order_rows(spark, sf), p, "asked", bucket="quarter")
    d = J.price_on_or_after(d.withColumnRenamed("price", "any_price"), p, "asked", within=3, bucket="quarter")
    return d.withColumnRenamed("price", "price_near").withColumnRenamed("any_price", "price")


@query("price_on_or_before", """
SELECT o.o_orderkey, o.tic, o.asked, p.close AS price FROM order_rows o ASOF LEFT JOIN prices p ON o.tic = p.tic AND o.asked >= p.date""")
def price_on_or_before(spark, sf):
    return J.price_on_or_before(_order_rows(spark, sf), P.prices(spark, sf).select("tic", "date", "close"), "asked", bucket="quarter")


@query("price_nearest_bounded", """
WITH q AS (SELECT DISTINCT tic, asked FROM order_rows),
n AS (SELECT q.tic, q.asked, arg_min(p.close, abs(p.date - q.asked) * 2 + (p.date < q.asked)::INT) AS price
      FROM q JOIN prices p ON p.tic = q.tic AND p.date BETWEEN q.asked - 5 AND q.asked + 5 GROUP BY 1, 2)
SELECT o_orderkey, tic, asked, price FROM order_rows LEFT JOIN n USING (tic, asked)""")
def price_nearest_bounded(spark, sf):
    return J.price_nearest_bounded(_order_rows(spark, sf), P.prices(spark, sf).select("tic", "date", "close"), "asked")


@query("as_of_slice", """
SELECT tic, date, close FROM (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY date DESC) AS rn FROM prices WHERE date <= DATE '1999-03-31') WHERE rn <= 20""")
def as_of_slice(spark, sf):
    return J.as_of_slice(P.prices(spark, sf).select("tic", "date", "close"), "1999-03-31", 20)


@query("align_common_dates", """
WITH g AS (SELECT tic, date FROM (SELECT DISTINCT tic FROM prices), (SELECT DISTINCT date FROM prices)),
f AS (SELECT tic, date, last_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close FROM g LEFT JOIN prices USING (tic, date)),
d AS (SELECT datadate FROM quarter_closes GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT tic) FROM quarter_closes))
SELECT 'forward' AS method, tic, date, close FROM f WHERE close IS NOT NULL
UNION ALL SELECT 'drop', tic, datadate, price FROM quarter_closes WHERE datadate IN (SELECT datadate FROM d)""")
def align_common_dates(spark, sf):
    f = J.align_common_dates(P.prices(spark, sf).select("tic", "date", "close"))
    q = P.quarter_closes(spark, sf).select("tic", F.col("datadate").alias("date"), F.col("price").alias("close"))
    d = J.align_common_dates(q, "drop")
    return f.withColumn("method", F.lit("forward")).unionByName(d.withColumn("method", F.lit("drop")))


@query("excess_residual_join", f"SELECT tic, date, {qcut('ret')} AS ret, {qcut('excess')} AS excess FROM excess")
def excess_residual_join(spark, sf):
    e = J.excess_residual(day_returns(spark, sf).select("tic", "date", "ret"), bench_returns(spark, sf))
    return e.select("tic", "date", cut(F.col("ret")).alias("ret"), cut(F.col("excess")).alias("excess"))


@query("prediction_merge", f"""
SELECT p.tic, p.datadate, {qcut('p.pred')} AS pred, {qcut('CASE WHEN p.n % 3 <> 0 THEN p.pred2 END')} AS unified, p.sector FROM predictions p""")
def prediction_merge(spark, sf):
    p = P.predictions(spark, sf)
    s = P.sectors(spark, sf)
    uni = p.filter(F.col("n") % 3 != 0).select("tic", "datadate", cut(F.col("pred2")).alias("unified"))
    some = s.filter(F.col("sector") != "ASIA")
    return J.prediction_merge(p.select("tic", "datadate", cut(F.col("pred")).alias("pred")), uni, some, s)


view("universe_days", """
SELECT date, tic FROM (SELECT c.date, (SELECT max(snap_date) FROM membership WHERE snap_date < c.date) AS snap_date FROM calendar c) d JOIN membership USING (snap_date)""")


def universe_days(spark, sf, only=None):
    sel = P.membership(spark, sf).withColumnRenamed("snap_date", "trade_date")
    return J.daily_universe_expand(sel, P.calendar(spark, sf), only=only)


@query("daily_universe_expand", "SELECT date, tic FROM universe_days")
def daily_universe_expand(spark, sf):
    return universe_days(spark, sf)


view("monthly_signal", """
SELECT tic, CAST(date_trunc('month', date) AS DATE) AS date, CASE WHEN max_by(close, date) > min_by(close, date) THEN 1 ELSE -1 END AS signal
FROM smooth GROUP BY 1, 2""")


def monthly_signal(spark, sf):
    """Written once: its dates, the last of them and its rows are read apart."""
    s = P.smooth(spark, sf).groupBy("tic", F.trunc("date", "month").alias("date"))
    s = s.agg(F.when(F.max_by("close", "date") > F.min_by("close", "date"), 1).otherwise(-1).alias("signal"))
    return scratch.cut_lineage(s, "monthly-signals")


@query("signal_expand_to_daily", """
WITH st AS (SELECT DISTINCT date AS start FROM monthly_signal),
d AS (SELECT c.date, (SELECT max(start) FROM st WHERE start <= c.date) AS start FROM calendar c),
e AS (SELECT date, start FROM d WHERE date < last_day((SELECT max(start) FROM st)))
SELECT e.date, s.tic, CASE WHEN u.tic IS NOT NULL THEN s.signal ELSE 0 END AS signal
FROM e JOIN monthly_signal s ON s.date = e.start LEFT JOIN universe_days u ON u.date = e.date AND u.tic = s.tic""")
def signal_expand_to_daily(spark, sf):
    return J.signal_expand_to_daily(monthly_signal(spark, sf), P.calendar(spark, sf), "M", universe_days(spark, sf))


@query("vintage_selection", f"""
WITH r AS (SELECT tic, datadate, price, y_return FROM predictions), mem AS (SELECT tic FROM membership WHERE snap_date = (SELECT max(snap_date) FROM membership)),
px AS (SELECT tic, min_by(close, date) FILTER (WHERE date >= DATE '2001-03-15') AS a, coalesce(min_by(close, date) FILTER (WHERE date >= DATE '2001-05-20'), max_by(close, date)) AS b
       FROM prices WHERE date BETWEEN DATE '2001-03-08' AND DATE '2001-05-23' GROUP BY 1)
SELECT 'mixed' AS mode, tic, strftime(datadate, '%Y-%m-%d') AS datadate, price, {qcut('y_return')} AS y_return, NULL AS original_datadate FROM r WHERE datadate <= DATE '2000-12-31'
UNION ALL SELECT 'mixed', tic, 'mixed', arg_max(price, datadate), {qcut('max_by(y_return, CASE WHEN true THEN datadate END)')}, strftime(max(datadate), '%Y-%m-%d') FROM r WHERE datadate > DATE '2000-12-31' AND tic IN (SELECT tic FROM mem) GROUP BY tic
UNION ALL SELECT 'latest', tic, strftime(datadate, '%Y-%m-%d'), price, {qcut('y_return')}, NULL FROM r WHERE datadate <= DATE '2000-12-31'
UNION ALL SELECT 'latest', tic, 'latest', p, {qcut('ln(b / a)')}, NULL FROM (SELECT tic, arg_max(price, datadate) AS p FROM r WHERE datadate <= DATE '2001-03-15' AND tic IN (SELECT tic FROM membership) GROUP BY 1) LEFT JOIN px USING (tic)""".replace(
    qcut('max_by(y_return, CASE WHEN true THEN datadate END)'), qcut("list_last(list(y_return ORDER BY datadate))")))
def vintage_selection(spark, sf):
    rows = P.predictions(spark, sf).select("tic", "datadate", "price", "y_return")
    m = P.membership(spark, sf)
    mixed = J.mixed_vintage(rows, m, "2000-12-31").withColumn("mode", F.lit("mixed"))
    latest = J.latest_snapshot(rows, m, P.prices(spark, sf).select("tic", "date", "close"), "2000-12-31", "2001-03-15", "2001-05-20")
    d = mixed.unionByName(latest.withColumn("mode", F.lit("latest")), allowMissingColumns=True)
    return d.withColumn("y_return", cut(F.col("y_return")))


@query("split_and_leak_check", """
SELECT CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS role, tic, count(*) AS rows, min(date) AS first, max(date) AS last FROM prices GROUP BY 1, 2""")
def split_and_leak_check(spark, sf):
    train, test = J.split_train_test(P.prices(spark, sf), "1999-12-31")
    train = J.leak_check(train, "1999-12-31").withColumn("role", F.lit("train"))
    d = train.unionByName(test.withColumn("role", F.lit("test")))
    return d.groupBy("role", "tic").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("benchmark_align", f"""
WITH s AS (SELECT 'bench' AS name, date, close AS value FROM bench UNION ALL SELECT sector, date, CAST(sum(CAST(floor(close * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 FROM smooth JOIN sectors USING (tic) WHERE sector IN ('ASIA', 'EUROPE') GROUP BY 1, 2),
c AS (SELECT date FROM s GROUP BY 1 HAVING count(*) = 3)
SELECT name, date, value, {qcut('value / first_value(value) OVER (PARTITION BY name ORDER BY date)')} AS level FROM s WHERE date IN (SELECT date FROM c)""")
def benchmark_align(spark, sf):
    b = P.bench(spark, sf).select(F.lit("bench").alias("name"), "date", F.col("close").alias("value"))
    d = P.smooth(spark, sf).join(P.sectors(spark, sf), "tic").groupBy(F.col("sector").alias("name"), "date").agg(
        (F.sum(F.floor(F.col("close") * 100)) / F.count("*") / 100).alias("value")
    )
    return J.benchmark_align(b.unionByName(d), ["bench", "ASIA", "EUROPE"]).withColumn("level", cut(F.col("level")))


@query("same_day_gap_adjust", f"""
WITH d AS (SELECT DISTINCT date FROM smooth WHERE date <= DATE '2001-09-16' ORDER BY date DESC LIMIT 2),
m AS (SELECT tic, max(close) FILTER (WHERE date = (SELECT max(date) FROM d)) / max(close) FILTER (WHERE date = (SELECT min(date) FROM d)) - 1 AS g FROM smooth GROUP BY 1)
SELECT tic, datadate, {qcut('coalesce(g, 0)')} AS realized, {qcut('pred - coalesce(g, 0)')} AS adjusted FROM predictions LEFT JOIN m USING (tic)""")
def same_day_gap_adjust(spark, sf):
    p = P.predictions(spark, sf).select("tic", "datadate", "pred")
    d = J.same_day_gap_adjust(p, P.smooth(spark, sf), "2001-09-16")
    return d.select("tic", "datadate", cut(F.col("realized")).alias("realized"), cut(F.col("adjusted")).alias("adjusted"))
