"""Aggregation and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import metrics as A
from stratapanel.plans import panel as P
from stratapanel.plans import rotation as T
from stratapanel.plans.cleaning_queries import buckets
from stratapanel.plans.feature_queries import _MEDL
from stratapanel.plans.registry import cut, qcut, query, view

view("sector_daily", """
SELECT sector AS name, date, CAST(sum(CAST(floor(close * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value FROM smooth JOIN sectors USING (tic) GROUP BY 1, 2""")
view("series_stats", """
SELECT name, date, value, value / lag(value) OVER (PARTITION BY name ORDER BY date) - 1 AS ret,
       value / max(value) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM sector_daily""")
view("weekly_stats", """
SELECT name, date, close AS value, close / lag(close) OVER (PARTITION BY name ORDER BY date) - 1 AS ret,
       close / max(close) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM sector_weekly""")


def sector_daily(spark, sf):
    d = P.smooth(spark, sf).join(P.sectors(spark, sf), "tic")
    return d.groupBy(F.col("sector").alias("name"), "date").agg(
        (F.sum(F.floor(F.col("close") * 100)) / F.count("*") / 100).alias("value")
    )


def cut_all(df, keys, digits=6):
    return df.select(*keys, *(cut(F.col(c), digits).alias(c) for c in df.columns if c not in keys))


@query("weekly_ohlcv", """
SELECT tic, w.week_end AS date, min_by(open, date) AS open, max(high) AS high, min(low) AS low, max_by(close, date) AS close, sum(volume) AS volume
FROM prices JOIN week_map w USING (date) GROUP BY 1, 2""")
def weekly_ohlcv(spark, sf):
    return A.weekly_ohlcv(P.prices(spark, sf), T.week_ends(spark, sf))


@query("month_last_price", "SELECT tic, last_day(date) AS month_end, max_by(close, date) AS close FROM prices GROUP BY 1, 2")
def month_last_price(spark, sf):
    return A.month_last_price(P.prices(spark, sf))


@query("group_equal_weight_return", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY date DESC) AS rn FROM weekly)
SELECT 'all' AS window, sector, date, {qcut('avg(ret)')} AS ret FROM weekly GROUP BY 2, 3
UNION ALL SELECT 'last', sector, date, {qcut('avg(CASE WHEN rn < 52 THEN ret END)')} FROM l WHERE rn <= 52 GROUP BY 2, 3""")
def group_equal_weight_return(spark, sf):
    w = T.weekly(spark, sf)
    every = A.group_equal_weight_return(w, "sector").withColumn("window", F.lit("all"))
    last = A.group_equal_weight_return(w, "sector", 52).withColumn("window", F.lit("last"))
    return every.unionByName(last).withColumn("ret", cut(F.col("ret")))


@query("compounded_return", f"""
SELECT tic, date, {qcut('product(1 + ret) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - 1')} AS ret_12 FROM weekly""")
def compounded_return(spark, sf):
    return T.weekly(spark, sf).select("tic", "date", cut(A.compounded_return(F.col("ret"), 12)).alias("ret_12"))


_GW = "OVER (PARTITION BY sector ORDER BY date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"
view("group_strength", f"""
WITH d AS (SELECT sector, date, g.ret AS g, b.ret AS b, g.ret - b.ret AS x FROM group_weekly g JOIN bench_weekly b USING (date)),
a AS (SELECT sector, date, count(x) {_GW} AS n, row_number() OVER (PARTITION BY sector ORDER BY date) AS rn, avg(x) {_GW} AS mu, stddev_samp(x) {_GW} AS sd,
  median(x) {_GW} AS c, list(x) {_GW} AS xs, product(CASE WHEN x IS NOT NULL THEN 1 + g END) {_GW} - product(CASE WHEN x IS NOT NULL THEN 1 + b END) {_GW} AS ex FROM d),
m AS (SELECT *, {_MEDL} AS m, n >= 9.6 AND rn >= 12 AS ok FROM a)
SELECT sector, date, n AS periods, ok AS is_valid, CASE WHEN ok THEN ex ELSE 0 END AS excess_return,
       CASE WHEN ok THEN coalesce(mu / coalesce(nullif(m, 0), nullif(sd, 0)), 0) ELSE 0 END AS information_ratio FROM m""")


@query("group_strength", f"""
SELECT sector, date, periods, is_valid, {qcut('excess_return')} AS excess_return, {qcut('information_ratio')} AS information_ratio FROM group_strength""")
def group_strength(spark, sf):
    daily = T.daily_panel(spark, sf)
    g = A.group_strength(T.group_returns(T.weekly(spark, sf, daily)), T.bench_weekly(spark, sf, daily))
    return g.select("sector", "date", "periods", "is_valid", cut(F.col("excess_return")).alias("excess_return"), cut(F.col("information_ratio")).alias("information_ratio"))


@query("monthly_metrics", f"""
WITH m AS (SELECT name, last_day(date) AS mo, product(1 + ret) - 1 AS r FROM series_stats WHERE ret IS NOT NULL GROUP BY 1, 2),
a AS (SELECT name, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd, coalesce(stddev_samp(r) FILTER (WHERE r < 0), 0) AS dn FROM m GROUP BY 1)
SELECT name, {qcut('mean')} AS monthly_return, {qcut('sd')} AS monthly_volatility, {qcut('CASE WHEN sd > 0 THEN mean / sd ELSE 0 END')} AS monthly_sharpe,
       {qcut('CASE WHEN dn > 0 THEN mean / dn ELSE 0 END')} AS monthly_sortino FROM a""")
def monthly_metrics(spark, sf):
    return cut_all(A.monthly_metrics(sector_daily(spark, sf)), ["name"])


_SPAN = "min_by(value, date) AS v0, max_by(value, date) AS v1, count(ret) AS n, min(dd) AS dd"
_BT = f"""
WITH a AS (SELECT name, {_SPAN}, coalesce(stddev_samp(ret), 0) AS sd, coalesce(stddev_samp(ret) FILTER (WHERE ret < 0), 0) AS dn, skewness(ret) AS sk, kurtosis(ret) AS ku FROM series_stats GROUP BY 1),
b AS (SELECT *, v1 / v0 - 1 AS tr, pow(v1 / v0, 252.0::DOUBLE / n) - 1 AS ar, sd * sqrt(252.0::DOUBLE) AS vol FROM a)
SELECT name, {qcut('tr')} AS total_return, {qcut('ar')} AS annual_return, {qcut('vol')} AS annual_volatility, {qcut('CASE WHEN vol > 0 THEN ar / vol ELSE 0 END')} AS sharpe_ratio,
       {qcut('CASE WHEN dn > 0 THEN ar / (dn * sqrt(252.0::DOUBLE)) ELSE 0 END')} AS sortino_ratio, {qcut('dd')} AS max_drawdown, {qcut('sk')} AS skewness, {qcut('ku')} AS kurtosis FROM b"""


@query("perf_metrics_backtest", _BT)
def perf_metrics_backtest(spark, sf):
    return cut_all(A.perf_metrics_backtest(sector_daily(spark, sf)), ["name"])


@query("perf_metrics_account", f"""
WITH a AS (SELECT name, {_SPAN}, stddev_pop(ret) AS sd, product(1 + ret) AS gr FROM series_stats GROUP BY 1),
b AS (SELECT *, (pow(gr, 252.0::DOUBLE / n) - 1) * 100 AS ar, sd * sqrt(252.0::DOUBLE) * 100 AS vol FROM a)
SELECT name, {qcut('(v1 / v0 - 1) * 100')} AS total_return, {qcut('ar')} AS annual_return, {qcut('vol')} AS annual_volatility,
       {qcut('(ar / 100 - 0.02::DOUBLE) / (vol / 100)')} AS sharpe_ratio, {qcut('dd * 100')} AS max_drawdown FROM b""")
def perf_metrics_account(spark, sf):
    return cut_all(A.perf_metrics_account(sector_daily(spark, sf)), ["name"])


@query("perf_metrics_weights", f"""
WITH r AS (SELECT date, ret FROM bench_weekly WHERE ret IS NOT NULL), e AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM r),
d AS (SELECT *, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
p AS (SELECT count(*) AS n, arg_max(eq, date) AS last, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol, avg(ret) * 252 AS mean, min(dd) AS dd FROM d),
w AS (SELECT date, tic, weight * (1 + month(date) / 100.0::DOUBLE) AS weight FROM equal_weights), s AS (SELECT date, sum(weight) AS s FROM w GROUP BY 1),
g AS (SELECT dt.date, t.tic, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT date FROM w) dt CROSS JOIN (SELECT DISTINCT tic FROM w) t LEFT JOIN w ON w.date = dt.date AND w.tic = t.tic),
c AS (SELECT date, abs(weight - lag(weight) OVER (PARTITION BY tic ORDER BY date)) AS c FROM g), t AS (SELECT date, sum(c) / 2 AS t FROM c WHERE c IS NOT NULL GROUP BY 1)
SELECT n AS n_days, {qcut('last - 1')} AS total_return, {qcut('pow(last, 252.0::DOUBLE / n) - 1')} AS annual_return, {qcut('vol')} AS annual_vol, {qcut('mean / vol')} AS sharpe, {qcut('dd')} AS max_drawdown,
  {qcut('(SELECT min(s) FROM s)')} AS weights_sum_min, {qcut('(SELECT avg(s) FROM s)')} AS weights_sum_mean, {qcut('(SELECT max(s) FROM s)')} AS weights_sum_max,
  {qcut('(SELECT sum(t) FROM t)')} AS total_turnover, {qcut('(SELECT avg(t) FROM t)')} AS avg_daily_turnover FROM p""")
def perf_metrics_weights(spark, sf):
    r = T.bench_weekly(spark, sf).filter(F.col("ret").isNotNull()).select("date", F.col("ret").alias("daily_return"))
    w = P.equal_membership_weights(spark, sf).withColumn("weight", F.col("weight") * (1 + F.month("date") / 100))
    return cut_all(A.perf_metrics_weights(r, w), ["n_days"])


@query("perf_metrics_weekly", f"""
WITH a AS (SELECT name, {_SPAN}, max(date) - min(date) AS days, stddev_samp(ret) * sqrt(52.0::DOUBLE) AS vol, count(*) FILTER (WHERE ret > 0) AS wins FROM weekly_stats GROUP BY 1),
b AS (SELECT *, pow(v1 / v0, 365.25::DOUBLE / days) - 1 AS ar FROM a)
SELECT name, {qcut('v1 / v0')} AS cumulative, {qcut('ar')} AS annual_return, {qcut('vol')} AS annual_volatility, {qcut('ar / vol')} AS sharpe_ratio, {qcut('dd')} AS max_drawdown,
       {qcut('ar / abs(dd)')} AS calmar_ratio, {qcut('CAST(wins AS DOUBLE) / n')} AS win_rate FROM b""")
def perf_metrics_weekly(spark, sf):
    from stratapanel.plans.feature_queries import sector_weekly

    return cut_all(A.perf_metrics_weekly(sector_weekly(spark, sf).withColumnRenamed("close", "value")), ["name"])


@query("var_cvar", f"""
WITH v AS (SELECT name, quantile_cont(ret, 0.05) AS v FROM series_stats GROUP BY 1)
SELECT name, {qcut('v')} AS var, {qcut('avg(ret) FILTER (WHERE ret <= v)')} AS cvar FROM series_stats JOIN v USING (name) GROUP BY name, v""")
def var_cvar(spark, sf):
    return cut_all(A.var_cvar(sector_daily(spark, sf)), ["name"])


_FEATS = ("revenue", "shares", "price", "pred", "pred2")
view("model_table", """
SELECT bucket, model, avg(e) AS val_mse FROM (SELECT bucket, unnest(['first', 'second', 'mean']) AS model, unnest([pow(y_return - pred, 2), pow(y_return - pred2, 2), pow(y_return - (pred + pred2) / 2, 2)]) AS e
FROM predictions JOIN buckets USING (tic) WHERE y_return IS NOT NULL) x GROUP BY 1, 2""")


@query("model_leaderboard", f"""
WITH m AS (SELECT model, avg(val_mse) AS v FROM model_table GROUP BY 1),
f AS (SELECT bucket, """ + ", ".join(f"abs(corr({c}, y_return)) AS {c}" for c in _FEATS) + """ FROM predictions JOIN buckets USING (tic) WHERE y_return IS NOT NULL GROUP BY 1),
u AS (UNPIVOT f ON """ + ", ".join(_FEATS) + f""" INTO NAME feature VALUE importance),
r AS (SELECT CASE feature WHEN 'price' THEN 'ret_1q' WHEN 'pred2' THEN 'sector_blend' ELSE feature END AS name, avg(importance) AS v FROM u WHERE bucket <> 'cyclical' GROUP BY 1)
SELECT 'model' AS kind, model AS name, {qcut('v')} AS value, model = (SELECT arg_min(model, v) FROM m) AS is_best, NULL AS class FROM m
UNION ALL SELECT 'feature', name, {qcut('v')}, true, CASE WHEN name = 'ret_1q' THEN 'momentum' WHEN name LIKE 'sector_%' THEN 'sector' ELSE 'fundamental' END FROM r""")
def model_leaderboard(spark, sf):
    p = P.predictions(spark, sf).join(buckets(spark, sf), "tic").filter(F.col("y_return").isNotNull())
    y = F.col("y_return")
    errors = {"first": y - F.col("pred"), "second": y - F.col("pred2"), "mean": y - (F.col("pred") + F.col("pred2")) / 2}
    m = p.groupBy("bucket").agg(*(F.avg(e * e).alias(k) for k, e in errors.items())).unpivot("bucket", list(errors), "model", "val_mse")
    names = {"revenue": "revenue", "shares": "shares", "price": "ret_1q", "pred": "pred", "pred2": "sector_blend"}
    f = p.groupBy("bucket").agg(*(F.abs(F.corr(c, "y_return")).alias(n) for c, n in names.items()))
    f = f.unpivot("bucket", list(names.values()), "feature", "importance").withColumn("is_best", F.col("bucket") != "cyclical")
    return A.model_leaderboard(m, f).withColumn("value", cut(F.col("value")))


@query("sector_daily_return", f"""
WITH m AS (SELECT date, tic, CAST(sum(CAST(round(p * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS price FROM trades GROUP BY 1, 2),
r AS (SELECT *, price / lag(price) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret FROM m)
SELECT date, tic, {qcut('price', 4)} AS price, {qcut('ret')} AS ret FROM r WHERE date >= DATE '1997-06-01'""")
def sector_daily_return(spark, sf):
    d = A.sector_daily_return(P.trades(spark, sf), "p", "1997-06-01")
    return d.select("date", "tic", cut(F.col("price"), 4).alias("price"), cut(F.col("ret")).alias("ret"))
