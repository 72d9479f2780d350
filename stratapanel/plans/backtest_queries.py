"""Back-test, cost and walk-forward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import backtest as Q
from stratapanel.operators import features as W
from stratapanel.operators import metrics as A
from stratapanel.operators import portfolio as B
from stratapanel.operators import ranking as X
from stratapanel.plans import panel as P
from stratapanel.plans import rotation as T
from stratapanel.plans.feature_queries import sector_weekly
from stratapanel.plans.metric_queries import cut_all
from stratapanel.plans.portfolio_queries import _OVERLAY, _SAFE, overlay
from stratapanel.plans.ranking_queries import bucket_preds, smooth_returns, z_of
from stratapanel.plans.registry import cut, qcut, query, view
from stratapanel.sources import scratch

view("aligned", """
WITH days AS (SELECT DISTINCT date FROM smooth), fp AS (SELECT tic, min(date) AS f FROM smooth GROUP BY 1),
m AS (SELECT date, (SELECT min(d.date) FROM days d WHERE d.date >= w.date) AS day FROM (SELECT DISTINCT date FROM equal_weights) w),
l AS (SELECT day, max(date) AS date FROM m WHERE day IS NOT NULL GROUP BY 1)
SELECT l.day AS date, tic, weight / sum(weight) OVER (PARTITION BY l.day) AS weight FROM equal_weights JOIN l USING (date) JOIN fp USING (tic) WHERE f <= l.day""")
view("strat_weights", """
SELECT 'all' AS strategy, date, tic, weight FROM aligned UNION ALL SELECT 'asia', date, tic, weight FROM aligned JOIN sectors USING (tic) WHERE sector = 'ASIA'""")
view("held", """
WITH g AS (SELECT strategy, d.date FROM (SELECT DISTINCT strategy FROM strat_weights) s, (SELECT DISTINCT date FROM smooth) d),
f AS (SELECT g.strategy, g.date, s.date AS f FROM g ASOF JOIN (SELECT DISTINCT strategy, date FROM strat_weights) s ON g.strategy = s.strategy AND g.date >= s.date)
SELECT f.strategy, f.date, tic, weight / sum(weight) OVER (PARTITION BY f.strategy, f.date) AS weight FROM f JOIN strat_weights w ON w.strategy = f.strategy AND w.date = f.f""")
view("trade_table", """
WITH o AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM smooth) d), w AS (SELECT strategy, ord, tic, weight FROM held JOIN o USING (date)),
r AS (SELECT tic, ord, ret FROM smooth_ret JOIN o USING (date)),
b AS (SELECT w.strategy, w.ord + 1 AS ord, w.tic, w.weight AS w0, coalesce(r.ret, 0) AS r FROM w LEFT JOIN r ON r.tic = w.tic AND r.ord = w.ord + 1 WHERE w.ord < (SELECT max(ord) FROM o)),
g AS (SELECT strategy, ord, sum(w0 * r) AS gross FROM b GROUP BY 1, 2)
SELECT strategy, date, tic, coalesce(gross, 0) AS gross, coalesce(weight, 0) - coalesce(w0 * (1 + r) / (1 + coalesce(gross, 0)), 0) AS change
FROM b FULL JOIN w USING (strategy, ord, tic) LEFT JOIN g USING (strategy, ord) JOIN o USING (ord)""")
view("net_path", """
WITH t AS (SELECT strategy, date, max(gross) AS gross, sum(abs(change)) AS turnover FROM trade_table GROUP BY 1, 2)
SELECT *, (1 + gross) * (1 - 0.001::DOUBLE * turnover) - 1 AS net FROM t""")
_UP = "(PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)"


def aligned(spark, sf, daily):
    return Q.weight_alignment(P.equal_membership_weights(spark, sf), daily)


def strategies(spark, sf, daily):
    """Two weight sets: all members, and the members of one sector."""
    a = scratch.cut_lineage(aligned(spark, sf, daily), "aligned")
    asia = a.join(P.sectors(spark, sf).filter(F.col("sector") == "ASIA").select("tic"), "tic", "left_semi")
    return a.withColumn("strategy", F.lit("all")).unionByName(asia.withColumn("strategy", F.lit("asia")))


def levels(daily):
    return daily.select("tic", "date", "close")


def held(spark, sf, daily):
    """Weights of every day. A back-test reads them once, so they are not written."""
    return Q.weight_ffill_normalise(strategies(spark, sf, daily), levels(daily))


@query("weight_alignment", f"SELECT date, tic, {qcut('weight')} AS weight FROM aligned")
def weight_alignment(spark, sf):
    return aligned(spark, sf, T.daily_panel(spark, sf)).withColumn("weight", cut(F.col("weight")))


@query("weight_ffill_normalise", f"SELECT strategy, date, tic, {qcut('weight')} AS weight FROM held")
def weight_ffill_normalise(spark, sf):
    return held(spark, sf, T.daily_panel(spark, sf)).withColumn("weight", cut(F.col("weight")))


@query("backtest_daily_rebalanced", f"""
SELECT strategy, date, {qcut('gross')} AS gross, {qcut('turnover')} AS turnover, {qcut('net')} AS net, {qcut(f'ln(product(1 + net) OVER {_UP})')} AS log_growth FROM net_path""")
def backtest_daily_rebalanced(spark, sf):
    daily = T.daily_panel(spark, sf)
    d = Q.backtest_daily_rebalanced(held(spark, sf, daily), levels(daily))
    return d.select("strategy", "date", cut(F.col("gross")).alias("gross"), cut(F.col("turnover")).alias("turnover"), cut(F.col("net")).alias("net"), cut(F.ln(F.col("value") / 1e6)).alias("log_growth"))


@query("benchmark_buy_hold", f"""
SELECT 'bench' AS name, date, {qcut('close / first_value(close) OVER (ORDER BY date) * 1e6', 2)} AS value FROM bench""")
def benchmark_buy_hold(spark, sf):
    b = P.bench(spark, sf).select(F.lit("bench").alias("name"), "date", F.col("close").alias("value"))
    return Q.benchmark_buy_hold(b).withColumn("value", cut(F.col("value"), 2))


@query("multi_strategy_backtest", f"""
WITH s AS (SELECT strategy AS name, date, 1e6::DOUBLE * product(1 + net) OVER {_UP} AS value FROM net_path UNION ALL SELECT 'bench', date, close FROM bench),
r AS (SELECT *, value / lag(value) OVER (PARTITION BY name ORDER BY date) - 1 AS ret, value / max(value) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM s),
a AS (SELECT name, max_by(value, date) / min_by(value, date) AS g, count(ret) AS n, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol, min(dd) AS dd, skewness(ret) AS sk FROM r GROUP BY 1)
SELECT name, {qcut('pow(g, 252.0::DOUBLE / n) - 1')} AS annual_return, {qcut('vol')} AS annual_volatility, {qcut('(pow(g, 252.0::DOUBLE / n) - 1) / vol')} AS sharpe_ratio, {qcut('dd')} AS max_drawdown, {qcut('sk')} AS skewness FROM a""")
def multi_strategy_backtest(spark, sf):
    daily = T.daily_panel(spark, sf)
    d = Q.backtest_daily_rebalanced(held(spark, sf, daily), levels(daily))
    s = d.select(F.col("strategy").alias("name"), "date", "value")
    s = s.unionByName(P.bench(spark, sf, daily).select(F.lit("bench").alias("name"), "date", F.col("close").alias("value")))
    s = scratch.cut_lineage(s, "values")
    m = A.perf_metrics_backtest(s).select("name", "annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "skewness")
    return cut_all(m, ["name"])


view("priced", f"""
WITH g AS (SELECT strategy, date, max(gross) AS g FROM trade_table GROUP BY 1, 2), v AS (SELECT strategy, date, 1e6::DOUBLE * product(1 + g) OVER {_UP} AS v FROM g),
l AS (SELECT tic, date, close, volume, coalesce(stddev_samp(lr) OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS vol FROM (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY tic ORDER BY date)), 0) AS lr FROM smooth) q)
SELECT t.strategy, t.date, t.tic, abs(change) * v AS traded, vol, abs(change) * v / close / volume AS part FROM (SELECT * FROM trade_table WHERE abs(change) > 1e-12) t ASOF JOIN l ON t.tic = l.tic AND t.date >= l.date JOIN v ON v.strategy = t.strategy AND v.date = t.date""")


def priced(spark, sf):
    daily = T.daily_panel(spark, sf)
    liq = W.logret_rolling_vol(daily, "close").select("tic", "date", "volume", "volatility")
    return Q.priced_trades(held(spark, sf, daily), levels(daily), liq)


@query("impact_cost", f"""
SELECT strategy, {qcut('ln(sum(traded * (0.0005::DOUBLE + 1.5::DOUBLE * vol * part)))')} AS log_impact, {qcut('ln(sum(traded * 0.001::DOUBLE))')} AS log_flat, {qcut('ln(sum(traded * 0.001::DOUBLE))')} AS log_degenerate FROM priced GROUP BY 1""")
def impact_cost(spark, sf):
    t = scratch.cut_lineage(priced(spark, sf), "priced")
    a = Q.total_costs(t, Q.impact_cost()).select("strategy", cut(F.ln("cost")).alias("log_impact"))
    b = Q.total_costs(t, Q.flat_cost()).select("strategy", cut(F.ln("cost")).alias("log_flat"))
    c = Q.total_costs(t, Q.impact_cost(0.0, 0.0, 0.001)).select("strategy", cut(F.ln("cost")).alias("log_degenerate"))
    return a.join(b, "strategy").join(c, "strategy")


_SCALES = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0)


@query("liquidity_sweep", " UNION ALL ".join(
    f"SELECT strategy, {s}::DOUBLE AS scale, {qcut(f'ln(sum(traded * (0.0005::DOUBLE + 1.5::DOUBLE * vol * (part / {s}::DOUBLE))))')} AS log_cost FROM priced GROUP BY 1" for s in _SCALES))
def liquidity_sweep(spark, sf):
    d = Q.liquidity_sweep(scratch.cut_lineage(priced(spark, sf), "priced"), Q.impact_cost(), _SCALES)
    return d.select("strategy", "scale", cut(F.ln("cost")).alias("log_cost"))


@query("period_portfolio_return", f"""
WITH d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM equal_weights) q), w AS (SELECT e.*, nd FROM equal_weights e JOIN d USING (date) WHERE nd IS NOT NULL),
a AS (SELECT w.*, s.close AS p0 FROM w ASOF LEFT JOIN smooth s ON s.tic = w.tic AND w.date >= s.date), b AS (SELECT a.*, s.close AS p1 FROM a ASOF LEFT JOIN smooth s ON s.tic = a.tic AND a.nd >= s.date),
r AS (SELECT date, nd, coalesce(sum(weight * (p1 / p0 - 1)), 0) AS ret FROM b GROUP BY 1, 2)
SELECT date, nd AS next_date, {qcut('ret')} AS ret, {qcut('ln(product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))')} AS log_value FROM r""")
def period_portfolio_return(spark, sf):
    d = Q.period_portfolio_return(P.equal_membership_weights(spark, sf), levels(T.daily_panel(spark, sf)))
    return d.select("date", "next_date", cut(F.col("ret")).alias("ret"), cut(F.ln("value")).alias("log_value"))


@query("long_only_quantile_portfolio", f"""
WITH q AS (SELECT *, quantile_cont(pred, 0.75) OVER (PARTITION BY datadate) AS q FROM bucket_preds), h AS (SELECT *, count(*) OVER (PARTITION BY datadate) AS held, sum(pred) OVER (PARTITION BY datadate) AS s FROM q WHERE pred >= q)
SELECT 'daily' AS kind, datadate, r.date, {qcut('sum(ret / held)')} AS ret FROM h JOIN smooth_ret r ON r.tic = h.tic AND CAST(date_trunc('quarter', r.date) AS DATE) = h.datadate + 1 WHERE ret IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'period', datadate, NULL, {qcut('sum(y_return * pred / s)')} FROM h GROUP BY 2""")
def long_only_quantile_portfolio(spark, sf):
    daily, period = Q.long_only_quantile_portfolio(bucket_preds(spark, sf), smooth_returns(spark, sf))
    a = daily.select(F.lit("daily").alias("kind"), "datadate", "date", cut(F.col("daily_return")).alias("ret"))
    b = period.select(F.lit("period").alias("kind"), "datadate", F.lit(None).cast("date").alias("date"), cut(F.col("period_return")).alias("ret"))
    return a.unionByName(b)


_PERIODS = """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM sector_weekly) q), r AS (SELECT date, lead(date) OVER (ORDER BY date) AS test_end FROM month_ends_reb),
p AS (SELECT r.date, r.test_end, d.ord, d.date AS dd FROM r ASOF JOIN d ON r.date >= d.date WHERE r.date <= (SELECT max(date) FROM d))"""
view("month_ends_reb", "SELECT date FROM week_ends WHERE last_day(date) = date OR month(date + 7) <> month(date)")


def _periods(spark, sf, window, size=None):
    from stratapanel.operators.calendar import month_end_rebalance_dates

    return Q.walk_forward_periods(month_end_rebalance_dates(P.calendar(spark, sf)), sector_weekly(spark, sf).select("date"), 52, window, size)


@query("walk_forward_periods", _PERIODS + """
SELECT 'expanding' AS kind, date AS decision_date, (SELECT min(date) FROM d) AS train_start, date AS train_end, test_end, ord AS available, ord >= 52 AS is_valid FROM p
UNION ALL SELECT 'rolling', p.date, d.date, p.date, test_end, p.ord, p.ord >= 52 FROM p JOIN d ON d.ord = greatest(p.ord - 25, 1)""")
def walk_forward_periods(spark, sf):
    a = _periods(spark, sf, "expanding").withColumn("kind", F.lit("expanding"))
    return a.unionByName(_periods(spark, sf, "rolling", 26).withColumn("kind", F.lit("rolling")))


@query("walk_forward_run", _PERIODS + f""",
x AS (SELECT p.date AS decision_date, s.name, max_by(s.close, s.date) / min_by(s.close, s.date) - 1 AS g FROM p JOIN d ON d.ord = greatest(p.ord - 25, 1) JOIN sector_weekly s ON s.date BETWEEN d.date AND p.date WHERE p.ord >= 52 GROUP BY 1, 2)
SELECT decision_date, arg_max(name, g) AS best, {qcut('max(g)')} AS growth, NULL::VARCHAR AS error FROM x GROUP BY 1
UNION ALL SELECT date, NULL, NULL, 'not enough data before' FROM p WHERE ord < 52""")
def walk_forward_run(spark, sf):
    import pandas as pd

    def strongest(key, rows):
        wide = rows.pivot(index="date", columns="name", values="close").sort_index()
        growth = wide.bfill().iloc[0].rdiv(wide.ffill().iloc[-1]) - 1
        return pd.DataFrame({"decision_date": [key[0]], "best": [growth.idxmax()], "growth": [growth.max()]})

    d = Q.walk_forward_run(_periods(spark, sf, "rolling", 26), sector_weekly(spark, sf), strongest, "decision_date date, best string, growth double")
    return d.withColumn("growth", cut(F.col("growth")))


_DECISION = _OVERLAY + """, rb AS (SELECT r.date, CASE WHEN s.is_active THEN 'fast_risk_off' ELSE r.state END AS regime, CASE WHEN s.is_active OR r.state = 'risk_off' THEN 0.7 WHEN r.state = 'neutral' THEN 0.85 ELSE 1.0 END::DOUBLE AS rb FROM regime r JOIN st s ON s.date = r.date AND s.params = 'base'),
g AS (SELECT date, count(DISTINCT sector) AS g FROM top_assets GROUP BY 1), a AS (SELECT date, sector, count(*) AS a FROM top_assets GROUP BY 1, 2),
m AS (SELECT t.date, t.sector, t.tic, rb / g / a * CASE WHEN k.trigger_count >= 2 OR sg2.strong THEN 1.5 ELSE 1.0 END AS w, regime FROM top_assets t JOIN g USING (date) JOIN a USING (date, sector) JOIN rb USING (date) LEFT JOIN mk k USING (tic, date) LEFT JOIN strong sg2 USING (tic, date)),
s AS (SELECT *, sum(w) OVER (PARTITION BY date) AS t FROM m),
dec AS (SELECT date, sector, tic, CASE WHEN t > 1 THEN w / t ELSE w END AS weight, greatest(1 - least(t, 1), 0) AS cash, regime FROM s
  UNION ALL SELECT date, 'FALLBACK', unnest(['GLD', 'TLT', 'SHY', 'XLP', 'XLU']), rb / 5, 1 - rb, regime FROM rb WHERE date NOT IN (SELECT date FROM active_groups WHERE is_active))
"""


def decision_weights(spark, sf):
    """Full decision of every week: overlay-aware budget, exceptions, weights or fallback."""
    d = T.decisions(spark, sf)
    o = overlay(spark, sf, d["index"]).filter(F.col("params") == "base").select("date", "is_active")
    budget = B.risk_budget(d["regime"].join(o, "date"))
    ex = X.exception_candidates(z_of(d["scores"]), d["bench"].select("date", "close")).filter("qualifies")
    w = B.portfolio_weights(d["top"], budget, ex.select("date", "tic"))
    f = B.fallback_portfolio(budget, d["strength"].filter("is_active"), _SAFE).withColumn("sector", F.lit("FALLBACK"))
    return w.select("date", "sector", "tic", "weight", "cash", "regime").unionByName(f.select("date", "sector", "tic", "weight", "cash", "regime"))


@query("single_decision", _DECISION + f"SELECT date, sector, tic, {qcut('weight')} AS weight, {qcut('cash')} AS cash, regime FROM dec")
def single_decision(spark, sf):
    return decision_weights(spark, sf).withColumns({"weight": cut(F.col("weight")), "cash": cut(F.col("cash"))})


@query("audit_rows", _DECISION + f"""SELECT date, regime, count(*) AS assets, string_agg(DISTINCT sector, ',' ORDER BY sector) AS groups, string_agg(tic, ',' ORDER BY tic) AS names, {qcut('max(cash)')} AS cash FROM dec GROUP BY 1, 2""")
def audit_rows(spark, sf):
    d = decision_weights(spark, sf)
    rows = d.groupBy("date", "regime").agg(
        F.max("cash").alias("cash"),
        F.array_sort(F.collect_set("sector")).alias("groups"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tic", "weight")))).alias("weights"),
    )
    path = scratch.new_path(spark, "audit")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    schema = "date date, regime string, cash double, groups array<string>, weights map<string, double>"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "date", "regime", F.size("weights").cast("long").alias("assets"), F.concat_ws(",", "groups").alias("groups"),
        F.concat_ws(",", F.array_sort(F.map_keys("weights"))).alias("names"), cut(F.col("cash")).alias("cash"),
    )


@query("backtest_summary", _DECISION + f""", q AS (SELECT date, regime, sum(weight) AS invested, count(*) AS num_assets FROM dec GROUP BY 1, 2)
SELECT coalesce(regime, 'all') AS regime, count(*) AS decisions, {qcut('avg(invested)')} AS avg_invested, {qcut('avg(num_assets)')} AS avg_assets, {qcut('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM q)')} AS share FROM q GROUP BY ROLLUP (regime)""")
def backtest_summary(spark, sf):
    d = scratch.cut_lineage(decision_weights(spark, sf), "decisions")
    q = d.groupBy("date", "regime").agg(F.sum("weight").alias("invested"), F.count("*").alias("num_assets"))
    return cut_all(A.backtest_summary(q), ["regime", "decisions"])
