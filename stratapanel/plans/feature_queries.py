"""Time-series feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import features as W
from stratapanel.plans import panel as P
from stratapanel.plans.cleaning_queries import day_returns
from stratapanel.plans.registry import cut, qcut, query, view
from stratapanel.sources import scratch

_W = "OVER (PARTITION BY tic ORDER BY date)"


def _rows(n):
    return f"OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(fn, x, n):
    return f"CASE WHEN count({x}) {_rows(n)} = {n} THEN {fn}({x}) {_rows(n)} END"


@query("simple_return", f"""
SELECT tic, date, {qcut('ret')} AS ret, {qcut(f'close / lag(close, 5) {_W} - 1')} AS ret_5,
       {qcut("last_value(CASE WHEN volume <> 13 THEN close END IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS UNBOUNDED PRECEDING) / last_value(CASE WHEN volume <> 13 THEN close END IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1")} AS ret_filled
FROM day_returns""")
def simple_return(spark, sf):
    p = P.prices(spark, sf)
    gappy = F.when(F.col("volume") != 13, F.col("close"))
    return p.select(
        "tic", "date", cut(W.simple_return(F.col("close"))).alias("ret"),
        cut(W.simple_return(F.col("close"), 5)).alias("ret_5"),
        cut(W.simple_return(gappy, ffill=True)).alias("ret_filled"),
    )


@query("sma", "SELECT tic, date, " + ", ".join(f"{qcut(_full('avg', 'close', n), 4)} AS sma_{n}" for n in (5, 10, 20, 50, 200)) + " FROM prices")
def sma(spark, sf):
    d = W.sma(P.prices(spark, sf).select("tic", "date", "close"), "close").drop("close")
    return d.select("tic", "date", *(cut(F.col(c), 4).alias(c) for c in d.columns if c.startswith("sma")))


@query("rolling_volatility", "SELECT tic, date, " + ", ".join(f"{qcut(_full('stddev_samp', 'ret', n))} AS vol_{n}" for n in (20, 60)) + " FROM day_returns")
def rolling_volatility(spark, sf):
    d = W.rolling_volatility(day_returns(spark, sf), "ret")
    return d.select("tic", "date", cut(F.col("vol_20")).alias("vol_20"), cut(F.col("vol_60")).alias("vol_60"))


@query("rsi_14", f"""
WITH d AS (SELECT tic, date, coalesce(close - lag(close) {_W}, 0) AS s FROM prices),
g AS (SELECT tic, date, count(*) {_rows(14)} AS n, avg(CASE WHEN s > 0 THEN s ELSE 0 END) {_rows(14)} AS up, avg(CASE WHEN s < 0 THEN -s ELSE 0 END) {_rows(14)} AS down FROM d)
SELECT tic, date, CASE WHEN n = 14 AND down = 0 AND up > 0 THEN 100 WHEN n = 14 AND down > 0 THEN {qcut('100 - 100 / (1 + up / down)')} END AS rsi_14 FROM g""")
def rsi_14(spark, sf):
    d = W.rsi(P.prices(spark, sf).select("tic", "date", "close"), "close")
    return d.select("tic", "date", cut(F.col("rsi_14")).alias("rsi_14"))


def _ewm(x, span):
    r = f"CAST({span - 1}.0 / {span + 1}.0 AS DOUBLE)"
    r = f"(CAST({span - 1} AS DOUBLE) / {span + 1})"
    return f"(sum({x} * pow({r}, -t)) OVER (PARTITION BY tic ORDER BY t) * pow({r}, t) * (1 - {r}) / (1 - pow({r}, t)))"


@query("macd", f"""
WITH n AS (SELECT tic, date, close, CAST(row_number() {_W} AS DOUBLE) AS t FROM prices),
m AS (SELECT tic, date, t, {_ewm('close', 12)} - {_ewm('close', 26)} AS macd FROM n)
SELECT tic, date, {qcut('macd', 3)} AS macd, {qcut(_ewm('macd', 9), 3)} AS macd_signal FROM m""")
def macd(spark, sf):
    d = W.macd(P.prices(spark, sf), "close")
    return d.select("tic", "date", cut(F.col("macd"), 3).alias("macd"), cut(F.col("macd_signal"), 3).alias("macd_signal"))


@query("profit_margin", f"SELECT tic, quarter_start, {qcut('net_revenue / revenue')} AS profit_margin FROM fundamentals")
def profit_margin(spark, sf):
    f = P.fundamentals(spark, sf).withColumnRenamed("net_revenue", "net_income")
    return W.profit_margin(f).select("tic", "quarter_start", cut(F.col("profit_margin")).alias("profit_margin"))


_CH = {"eps": "eps_chg", "pred": "roe_chg", "pred2": "gm_chg"}
_MOM = ["ret_1q", "ret_4q", *_CH.values()]


@query("momentum_features", """
WITH b AS (SELECT tic, datadate, price, net_revenue / shares AS eps, pred, pred2 FROM predictions),
r AS (SELECT tic, datadate, price / lag(price) OVER w - 1 AS ret_1q, price / lag(price, 4) OVER w - 1 AS ret_4q, """
+ ", ".join(f"{s} - lag({s}) OVER w AS {d}" for s, d in _CH.items()) + """ FROM b WINDOW w AS (PARTITION BY tic ORDER BY datadate)),
f AS (SELECT tic, datadate, """ + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM r)) AS {c}" for c in _MOM) + """ FROM r),
q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_l, quantile_cont({c}, 0.99) AS {c}_h" for c in _MOM) + """ FROM f),
c AS (SELECT tic, datadate, """ + ", ".join(f"least(greatest({c}, {c}_l), {c}_h) AS {c}" for c in _MOM) + """ FROM f, q),
a AS (SELECT *, ret_1q - ret_4q / 4 AS ret_accel FROM c),
z AS (SELECT quantile_cont(ret_accel, 0.01) AS l, quantile_cont(ret_accel, 0.99) AS h FROM a)
SELECT tic, datadate, """ + ", ".join(f"{qcut(c)} AS {c}" for c in _MOM) + f", {qcut('least(greatest(ret_accel, l), h)')} AS ret_accel FROM a, z")
def momentum_features(spark, sf):
    p = P.predictions(spark, sf).select(
        "tic", "datadate", F.col("price").alias("trade_price"), (F.col("net_revenue") / F.col("shares")).alias("eps"), "pred", "pred2"
    )
    d = W.momentum_features(p, _CH)
    return d.select("tic", "datadate", *(cut(F.col(c)).alias(c) for c in [*_MOM, "ret_accel"]))


@query("logret_rolling_vol", f"""
WITH l AS (SELECT tic, date, coalesce(ln(close / lag(close) {_W}), 0) AS r FROM prices)
SELECT tic, date, {qcut('r')} AS log_ret, {qcut(f'coalesce(stddev_samp(r) {_rows(20)}, 0)')} AS volatility FROM l""")
def logret_rolling_vol(spark, sf):
    d = W.logret_rolling_vol(P.prices(spark, sf), "close")
    return d.select("tic", "date", cut(F.col("log_ret")).alias("log_ret"), cut(F.col("volatility")).alias("volatility"))


@query("volume_panel", """
WITH v AS (SELECT tic, date, arg_max(CASE WHEN CAST(quantity AS BIGINT) % 10 = 0 THEN 0 ELSE quantity END, k * 100 + quantity) AS v FROM trades GROUP BY 1, 2)
SELECT tic, date, coalesce(last_value(nullif(v, 0) IGNORE NULLS) OVER (PARTITION BY tic ORDER BY date ROWS UNBOUNDED PRECEDING), 1) AS volume FROM v""")
def volume_panel(spark, sf):
    t = P.trades(spark, sf).select(
        "tic", "date", F.when(F.col("quantity").cast("long") % 10 == 0, 0.0).otherwise(F.col("quantity")).alias("v"),
        (F.col("k") * 100 + F.col("quantity")).alias("seq"),
    )
    return W.volume_panel(t, "v", "seq")


@query("future_return_label", f"SELECT tic, date, {qcut(f'lead(close, 63) {_W} / close - 1')} AS future_return FROM prices")
def future_return_label(spark, sf):
    return P.prices(spark, sf).select("tic", "date", cut(W.future_return_label(F.col("close"))).alias("future_return"))


@query("forward_log_return", """
WITH f AS (SELECT tic, datadate, ln(lead(price) OVER (PARTITION BY tic ORDER BY datadate) / price) AS y FROM quarter_closes)
SELECT f.tic, f.datadate, round(y, 6) AS y_return, c.rows, 0::BIGINT AS wrong, c.unlabelled FROM f,
(SELECT count(*) AS rows, count(*) FILTER (WHERE y IS NULL) AS unlabelled FROM f) c""")
def forward_log_return(spark, sf):
    q = P.quarter_closes(spark, sf).withColumn("y_return", W.forward_log_return(F.col("price")))
    check = W.label_check(q, "price", "y_return").select(F.struct("rows", "wrong", "unlabelled")).scalar()
    return q.withColumn("c", check).select("tic", "datadate", "y_return", "c.rows", "c.wrong", "c.unlabelled")


@query("last_label_fill", """
WITH q AS (SELECT tic, datadate, price, ln(lead(price) OVER (PARTITION BY tic ORDER BY datadate) / price) AS y
           FROM quarter_closes),
l AS (SELECT tic, max(datadate) AS datadate, arg_max(price, datadate) AS price FROM q GROUP BY 1),
t AS (SELECT *, last_day(CAST(date_trunc('month', datadate) + INTERVAL 3 MONTH AS DATE)) AS target FROM l),
n AS (SELECT t.tic, t.datadate, t.price, arg_min(s.close, abs(s.date - target) * 2 + (s.date > target)::INT) FILTER (WHERE s.date >= target - 7) AS near, arg_max(s.close, s.date) AS last
      FROM t JOIN smooth s ON s.tic = t.tic AND s.date <= target + 3 GROUP BY ALL)
SELECT q.tic, q.datadate, q.price, """ + qcut("coalesce(q.y, ln(coalesce(n.near, n.last) / n.price))") + """ AS y_return
FROM q LEFT JOIN n USING (tic, datadate)""")
def last_label_fill(spark, sf):
    q = P.quarter_closes(spark, sf)
    w = Window.partitionBy("tic").orderBy("datadate")
    q = q.withColumn("y_return", F.ln(F.lead("price").over(w) / F.col("price")))
    d = W.last_label_fill(q, P.smooth(spark, sf).select("tic", "date", "close"))
    return d.select("tic", "datadate", "price", cut(F.col("y_return")).alias("y_return"))


def _mad_sql(x, n, center="median"):
    return f"""SELECT tic, date, {x} AS x, count({x}) {_rows(n)} AS n, {center}({x}) {_rows(n)} AS c, list({x}) {_rows(n)} AS xs FROM day_returns"""


def _z_sql(n):
    return f"CASE WHEN n < {n} OR x IS NULL THEN NULL WHEN m < 1e-6 THEN CASE WHEN abs(x - c) < 1e-6 THEN 0 ELSE 10 * sign(x - c) END ELSE (x - c) / m END"


_MEDL = "list_aggregate(list_transform(xs, lambda v: abs(v - c)), 'median')"


@query("robust_zscore", f"""
WITH a AS ({_mad_sql('ret', 12)}), b AS (SELECT *, {_MEDL} AS m FROM a),
d AS ({_mad_sql('ret', 12, 'avg')}), e AS (SELECT *, {_MEDL} AS m FROM d),
za AS (SELECT tic, date, {qcut(_z_sql(12), 4)} AS z FROM b), ze AS (SELECT tic, date, {qcut(_z_sql(12), 4)} AS z_mean FROM e)
SELECT * FROM za JOIN ze USING (tic, date)""")
def robust_zscore(spark, sf):
    r = F.col("ret")
    return day_returns(spark, sf).select(
        "tic", "date", cut(W.robust_zscore(r, 12), 4).alias("z"), cut(W.robust_zscore(r, 12, "mean"), 4).alias("z_mean")
    )


view("rolling_dev", f"SELECT tic, date, ret, abs(ret - {_full('median', 'ret', 12)}) AS dev, {_full('median', 'ret', 12)} AS med FROM day_returns")


@query("mad", f"""
WITH w AS (SELECT tic, median(ret) AS med FROM day_returns GROUP BY 1),
m AS (SELECT tic, median(abs(ret - med)) AS mad FROM day_returns JOIN w USING (tic) GROUP BY 1)
SELECT tic, date, {qcut(_full('median', 'dev', 12))} AS rolling_mad, {qcut('mad')} AS mad, {qcut('mad * 1.4826::DOUBLE')} AS mad_std
FROM rolling_dev JOIN m USING (tic)""")
def mad(spark, sf):
    r = scratch.cut_lineage(day_returns(spark, sf).select("tic", "date", "ret"), "returns")
    whole = W.mad(r, ["tic"], "ret")
    d = W.with_rolling_mad(r, "ret", 12, "rolling_mad").join(whole, "tic")
    return d.select("tic", "date", *(cut(F.col(c)).alias(c) for c in ("rolling_mad", "mad", "mad_std")))


view("bench_ret", "SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bret FROM bench")


def bench_returns(spark, sf):
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return P.bench(spark, sf).select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))


view("excess", """
SELECT tic, date, ret, bret, ret - bret AS excess FROM day_returns JOIN bench_ret USING (date)""")


@query("information_ratio", f"""
WITH a AS (SELECT tic, date, count(excess) {_rows(12)} AS n, avg(excess) {_rows(12)} AS mu, stddev_samp(excess) {_rows(12)} AS sd,
           median(excess) {_rows(12)} AS c, list(excess) {_rows(12)} AS xs FROM excess),
b AS (SELECT *, {_MEDL} AS m FROM a)
SELECT tic, date, {qcut('CASE WHEN n = 12 THEN mu / coalesce(nullif(m, 0), nullif(sd, 0)) END')} AS ir,
       {qcut('CASE WHEN n = 12 THEN mu / nullif(sd, 0) * sqrt(52.0::DOUBLE) END')} AS ir_std FROM b""")
def information_ratio(spark, sf):
    from stratapanel.operators.joins import excess_residual

    e = excess_residual(day_returns(spark, sf).select("tic", "date", "ret"), bench_returns(spark, sf))
    x = F.col("excess")
    return e.select(
        "tic", "date", cut(W.information_ratio(x, 12)).alias("ir"),
        cut(W.information_ratio(x, 12, robust=False, scale=52.0)).alias("ir_std"),
    )


@query("outliers_and_mad_winsorize", f"""
WITH a AS (SELECT tic, date, ret AS x, row_number() {_W} AS rn, count(ret) {_rows(12)} AS n, median(ret) {_rows(12)} AS c, list(ret) {_rows(12)} AS xs, ret FROM day_returns),
b AS (SELECT *, {_MEDL} AS m FROM a), z AS (SELECT *, {_z_sql(12)} AS z FROM b),
r AS (SELECT tic, date, {_full('median', 'dev', 12)} AS rmad, med FROM rolling_dev)
SELECT tic, date, coalesce(abs(z) > 3, false) AS outlier,
       {qcut('CASE WHEN rn < 12 THEN x WHEN z IS NOT NULL THEN med + least(greatest(z, -3), 3) * rmad END')} AS winsorized
FROM z JOIN r USING (tic, date)""")
def outliers_and_mad_winsorize(spark, sf):
    d = W.outliers_and_mad_winsorize(day_returns(spark, sf).select("tic", "date", "ret"), "ret", 12)
    return d.select("tic", "date", "outlier", cut(F.col("winsorized")).alias("winsorized"))


@query("rolling_sharpe", f"""
SELECT tic, date, {qcut(f"CASE WHEN count(ret) {_rows(252)} = 252 THEN CASE WHEN stddev_samp(ret) {_rows(252)} > 0 THEN avg(ret) {_rows(252)} / stddev_samp(ret) {_rows(252)} * sqrt(252.0::DOUBLE) ELSE 0 END END")} AS sharpe
FROM day_returns""")
def rolling_sharpe(spark, sf):
    d = W.rolling_sharpe(day_returns(spark, sf).select("tic", "date", "ret"), "ret", "sharpe")
    return d.select("tic", "date", cut(F.col("sharpe")).alias("sharpe"))


@query("drawdown_curve", f"""
WITH d AS (SELECT tic, date, close / max(close) OVER (PARTITION BY tic ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM prices)
SELECT tic, date, {qcut('dd')} AS drawdown, {qcut('min(dd) OVER (PARTITION BY tic ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS max_drawdown FROM d""")
def drawdown_curve(spark, sf):
    d = P.prices(spark, sf).select("tic", "date", W.drawdown(F.col("close")).alias("dd"))
    low = F.min("dd").over(Window.partitionBy("tic").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("tic", "date", cut(F.col("dd")).alias("drawdown"), cut(low).alias("max_drawdown"))


view("sector_weekly", """
SELECT sector AS name, CAST(date_trunc('week', date) AS DATE) AS date, CAST(sum(CAST(floor(close * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close
FROM smooth JOIN sectors USING (tic) GROUP BY 1, 2""")
view("sector_weekly_ret", "SELECT name, date, close / lag(close) OVER (PARTITION BY name ORDER BY date) - 1 AS r FROM sector_weekly")


def sector_weekly(spark, sf):
    """Weekly mean level of each sector: a short list of series."""
    d = P.smooth(spark, sf).join(P.sectors(spark, sf), "tic")
    return d.groupBy(F.col("sector").alias("name"), F.trunc("date", "week").alias("date")).agg(
        (F.sum(F.floor(F.col("close") * 100)) / F.count("*") / 100).alias("close")
    )


def sector_names(spark, sf):
    """The names of the sector series, a short list."""
    return [r.sector for r in P.sectors(spark, sf).select("sector").distinct().collect()]


@query("rolling_covariance", f"""
WITH p AS (SELECT a.date, a.name AS name_i, b.name AS name_j, a.r AS ra, b.r AS rb FROM sector_weekly_ret a JOIN sector_weekly_ret b ON a.date = b.date AND a.name <= b.name),
c AS (SELECT date, name_i, name_j, count(ra * rb) OVER w AS n, covar_samp(ra, rb) OVER w AS cov FROM p WINDOW w AS (PARTITION BY name_i, name_j ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
SELECT date, name_i, name_j, {qcut('cov', 9)} AS cov FROM c WHERE n = 52""")
def rolling_covariance(spark, sf):
    d = W.rolling_covariance(sector_weekly(spark, sf), sector_names(spark, sf), 52)
    return d.withColumn("cov", cut(F.col("cov"), 9))


@query("correlation_matrix", f"""
SELECT a.name AS name_i, b.name AS name_j, {qcut('corr(a.r, b.r)')} AS corr FROM sector_weekly_ret a JOIN sector_weekly_ret b ON a.date = b.date AND a.name <= b.name GROUP BY 1, 2""")
def correlation_matrix(spark, sf):
    return W.correlation_matrix(sector_weekly(spark, sf), sector_names(spark, sf)).withColumn("corr", cut(F.col("corr")))


@query("frozen_price_pairs", """
WITH l AS (SELECT tic, floor(close / 2000) AS p, lag(floor(close / 2000)) OVER (PARTITION BY tic ORDER BY date) AS q FROM prices)
SELECT tic, count(*) FILTER (WHERE p = q AND p > 0) AS frozen FROM l GROUP BY 1""")
def frozen_price_pairs(spark, sf):
    p = P.prices(spark, sf).select("tic", "date", F.floor(F.col("close") / 2000).alias("p"))
    return W.frozen_price_pairs(p, "p")
