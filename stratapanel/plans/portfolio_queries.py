"""Regime, portfolio, order and execution queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import calendar as C
from stratapanel.operators import joins as J
from stratapanel.operators import metrics as A
from stratapanel.operators import portfolio as B
from stratapanel.operators import regime as G
from stratapanel.plans import panel as P
from stratapanel.plans import rotation as T
from stratapanel.plans.feature_queries import _MEDL
from stratapanel.plans.join_queries import monthly_signal, universe_days
from stratapanel.plans.ranking_queries import bucket_preds, z_of
from stratapanel.plans.registry import cut, qcut, query, view
from stratapanel.sources import scratch


def _o(n):
    return f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_Z = "CASE WHEN m < 1e-6 THEN CASE WHEN abs({x} - c) < 1e-6 THEN 0 ELSE 10 * sign({x} - c) END ELSE ({x} - c) / m END"
view("slow_regime", f"""
WITH a AS (SELECT date, spx, vix, CASE WHEN count(*) {_o(26)} = 26 THEN avg(spx) {_o(26)} END AS ma, CASE WHEN count(*) {_o(13)} = 13 THEN (spx - max(spx) {_o(13)}) / max(spx) {_o(13)} END AS dd,
   count(*) {_o(156)} AS n, median(vix) {_o(156)} AS c, list(vix) {_o(156)} AS xs FROM index_weekly),
b AS (SELECT *, {_MEDL} AS m FROM a), z AS (SELECT *, CASE WHEN n >= 52 THEN {_Z.format(x='vix')} ELSE 0 END AS vix_z FROM b)
SELECT date, spx, ma, coalesce(dd, 0) AS drawdown, vix_z, coalesce(spx < ma, false) AS trend_down, coalesce(dd <= -0.10, false) AS drawdown_stress, vix_z >= 3 AS vol_stress,
  CAST(coalesce(spx < ma, false)::INT + coalesce(dd <= -0.10, false)::INT + (vix_z >= 3)::INT AS BIGINT) AS risk_score FROM z""")
view("regime", """
WITH s AS (SELECT *, CASE risk_score WHEN 0 THEN 'risk_on' WHEN 1 THEN 'neutral' ELSE 'risk_off' END AS state FROM slow_regime)
SELECT date, risk_score, state, CASE state WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.7 ELSE 0.5 END::DOUBLE AS group_cap, CASE state WHEN 'risk_on' THEN 0.0 WHEN 'neutral' THEN 0.1 ELSE 0.3 END::DOUBLE AS cash_floor,
  coalesce(lag(state) OVER (ORDER BY date) = state, false) AS is_persistent FROM s""")


@query("slow_regime", f"""
SELECT date, {qcut('ma', 4)} AS ma, {qcut('drawdown')} AS drawdown, {qcut('vix_z', 4)} AS vix_z, trend_down, drawdown_stress, vol_stress, risk_score FROM slow_regime""")
def slow_regime(spark, sf):
    d = G.slow_regime(T.index_weekly(spark, sf))
    return d.select("date", cut(F.col("ma"), 4).alias("ma"), cut(F.col("drawdown")).alias("drawdown"), cut(F.col("vix_z"), 4).alias("vix_z"),
                    "trend_down", "drawdown_stress", "vol_stress", "risk_score")


@query("regime_mapping", "SELECT date, risk_score, state, group_cap, cash_floor, is_persistent FROM regime")
def regime_mapping(spark, sf):
    return T.regime_weekly(spark, sf).select("date", "risk_score", "state", "group_cap", "cash_floor", "is_persistent")


view("shocks", f"""
WITH d AS (SELECT *, vix - lag(vix) OVER (ORDER BY date) AS dv FROM index_daily),
a AS (SELECT *, count(vix) {_o(756)} AS n, median(vix) {_o(756)} AS c, list(vix) {_o(756)} AS xs FROM d), b AS (SELECT *, {_MEDL} AS m FROM a),
v AS (SELECT date, spx, qqq, vix, dv, CASE WHEN n >= 252 THEN {_Z.format(x='vix')} ELSE 0 END AS vix_z FROM b),
e AS (SELECT *, count(dv) {_o(756)} AS n, median(dv) {_o(756)} AS c, list(dv) FILTER (WHERE dv IS NOT NULL) {_o(756)} AS xs FROM v), f AS (SELECT *, {_MEDL} AS m FROM e),
g AS (SELECT date, spx, vix_z, CASE WHEN n = 756 THEN {_Z.format(x='dv')} ELSE 0 END AS dvix_z, coalesce(spx / lag(spx, 3) OVER (ORDER BY date) - 1, 0) AS spx_ret, coalesce(qqq / lag(qqq, 3) OVER (ORDER BY date) - 1, 0) AS qqq_ret FROM f)
SELECT *, spx_ret <= -0.03 OR qqq_ret <= -0.03 AS price_shock, vix_z >= 3 AND dvix_z >= 3.5 AS vol_shock, spx_ret <= -0.03 OR qqq_ret <= -0.03 OR (vix_z >= 3 AND dvix_z >= 3.5) AS trigger FROM g""")


@query("price_vol_shock", f"""
SELECT date, {qcut('spx_ret')} AS spx_ret, {qcut('qqq_ret')} AS qqq_ret, {qcut('vix_z', 4)} AS vix_z, {qcut('dvix_z', 4)} AS dvix_z, price_shock, vol_shock, trigger FROM shocks""")
def price_vol_shock(spark, sf):
    d = G.price_vol_shock(T.index_daily(spark, sf))
    return d.select("date", *(cut(F.col(c)).alias(c) for c in ("spx_ret", "qqq_ret")), *(cut(F.col(c), 4).alias(c) for c in ("vix_z", "dvix_z")), "price_shock", "vol_shock", "trigger")


_SETS = [("base", 10, 0.01), ("short", 5, 0.01), ("patient", 10, 0.05)]
view("overlay_rows", """
SELECT date, trigger, row_number() OVER (ORDER BY date) AS rn, spx / lag(spx, 2) OVER (ORDER BY date) - 1 AS r2, spx / lag(spx, 3) OVER (ORDER BY date) - 1 AS r3 FROM shocks""")
view("overlay_sets", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {x}::DOUBLE)" for n, k, x in _SETS) + ") t(params, duration, exit_at)")
_OVERLAY = """
WITH RECURSIVE nxt AS MATERIALIZED (SELECT rn, date, trigger, r2, r3 FROM overlay_rows),
st AS (SELECT params, duration, exit_at, 0::BIGINT AS rn, NULL::DATE AS date, NULL::BIGINT AS start, false AS is_active, 0::BIGINT AS days_remaining, 'inactive' AS reason FROM overlay_sets
  UNION ALL
  SELECT params, duration, exit_at, n.rn, n.date,
    CASE WHEN s.start IS NULL THEN CASE WHEN n.trigger THEN n.rn END WHEN n.rn - s.start >= duration THEN NULL WHEN n.rn - s.start >= 3 AND CASE WHEN n.rn - s.start >= 4 THEN n.r3 ELSE n.r2 END > exit_at THEN NULL ELSE s.start END,
    CASE WHEN s.start IS NULL THEN n.trigger WHEN n.rn - s.start >= duration THEN false WHEN n.rn - s.start >= 3 AND CASE WHEN n.rn - s.start >= 4 THEN n.r3 ELSE n.r2 END > exit_at THEN false ELSE true END,
    CASE WHEN s.start IS NULL THEN CASE WHEN n.trigger THEN duration ELSE 0 END WHEN n.rn - s.start >= duration THEN 0 WHEN n.rn - s.start >= 3 AND CASE WHEN n.rn - s.start >= 4 THEN n.r3 ELSE n.r2 END > exit_at THEN 0 ELSE duration - (n.rn - s.start) END,
    CASE WHEN s.start IS NULL THEN CASE WHEN n.trigger THEN 'triggered' ELSE 'inactive' END WHEN n.rn - s.start >= duration THEN 'duration_expired' WHEN n.rn - s.start >= 3 AND CASE WHEN n.rn - s.start >= 4 THEN n.r3 ELSE n.r2 END > exit_at THEN 'recovery' ELSE 'active' END
  FROM st s JOIN nxt n ON n.rn = s.rn + 1)
"""


def overlay(spark, sf, index=None):
    index = T.index_daily(spark, sf) if index is None else index
    return G.fast_overlay_state(G.price_vol_shock(index).select("date", "spx", "trigger"), _SETS)


@query("fast_overlay_state", _OVERLAY + "SELECT params, st.date, is_active, days_remaining, x.date AS trigger_date, reason FROM st LEFT JOIN nxt x ON x.rn = st.start WHERE st.rn > 0")
def fast_overlay_state(spark, sf):
    return overlay(spark, sf)


@query("effective_regime", _OVERLAY + """, w AS (SELECT st.params, st.date, st.is_active, r.state, r.group_cap, r.cash_floor FROM st ASOF JOIN regime r ON st.date >= r.date WHERE st.rn > 0)
SELECT params, date, CASE WHEN is_active THEN least(group_cap, 0.3::DOUBLE) ELSE group_cap END AS effective_cap, CASE WHEN is_active THEN greatest(cash_floor, 0.5::DOUBLE) ELSE cash_floor END AS effective_floor,
  CASE WHEN is_active THEN 'fast_risk_off' ELSE state END AS effective_state FROM w""")
def effective_regime(spark, sf):
    index = T.index_daily(spark, sf)
    d = G.effective_regime(overlay(spark, sf, index), T.regime_weekly(spark, sf, index))
    return d.select("params", "date", "effective_cap", "effective_floor", "effective_state")


@query("risk_budget", _OVERLAY + """SELECT r.date, CASE WHEN s.is_active THEN 'fast_risk_off' ELSE r.state END AS regime,
  CASE WHEN s.is_active OR r.state = 'risk_off' THEN 0.7 WHEN r.state = 'neutral' THEN 0.85 ELSE 1.0 END::DOUBLE AS risk_budget FROM regime r JOIN st s ON s.date = r.date AND s.params = 'base'""")
def risk_budget(spark, sf):
    index = T.index_daily(spark, sf)
    o = overlay(spark, sf, index).filter(F.col("params") == "base").select("date", "is_active")
    return B.risk_budget(T.regime_weekly(spark, sf, index).join(o, "date"))


view("budget", "SELECT date, state AS regime, CASE state WHEN 'risk_off' THEN 0.7 WHEN 'neutral' THEN 0.85 ELSE 1.0 END::DOUBLE AS risk_budget FROM regime")
view("rotation", """
WITH g AS (SELECT date, count(DISTINCT sector) AS g FROM top_assets GROUP BY 1), a AS (SELECT date, sector, count(*) AS a FROM top_assets GROUP BY 1, 2)
SELECT t.date, t.sector, t.tic, t.zscore, b.risk_budget / g.g / a.a AS weight, b.regime, b.risk_budget FROM top_assets t JOIN g USING (date) JOIN a USING (date, sector) JOIN budget b USING (date)""")


@query("portfolio_weights", f"""
WITH m AS (SELECT r.*, r.weight * CASE WHEN k.trigger_count >= 2 THEN 1.5 ELSE 1.0 END AS w FROM rotation r LEFT JOIN mk k USING (tic, date)),
s AS (SELECT *, sum(w) OVER (PARTITION BY date) AS t FROM m)
SELECT date, sector, tic, {qcut('CASE WHEN t > 1 THEN w / t ELSE w END')} AS weight, {qcut('greatest(1 - least(t, 1), 0)')} AS cash, regime, risk_budget FROM s""")
def portfolio_weights(spark, sf):
    from stratapanel.operators.ranking import exception_mk

    d = T.decisions(spark, sf)
    ex = exception_mk(z_of(d["scores"])).filter("mk").select("date", "tic")
    w = B.portfolio_weights(d["top"], d["budget"], ex)
    return w.select("date", "sector", "tic", cut(F.col("weight")).alias("weight"), cut(F.col("cash")).alias("cash"), "regime", "risk_budget")


_SAFE = ("GLD", "TLT", "SHY", "XLP", "XLU")


@query("fallback_portfolio", f"""
SELECT date, unnest(['GLD', 'TLT', 'SHY', 'XLP', 'XLU']) AS tic, {qcut('risk_budget / 5')} AS weight, {qcut('1 - risk_budget')} AS cash, regime FROM budget
WHERE date NOT IN (SELECT date FROM active_groups WHERE is_active)""")
def fallback_portfolio(spark, sf):
    d = T.decisions(spark, sf)
    f = B.fallback_portfolio(d["budget"], d["strength"].filter("is_active"), _SAFE)
    return f.select("date", "tic", cut(F.col("weight")).alias("weight"), cut(F.col("cash")).alias("cash"), "regime")


view("positions", """
SELECT tic, date, close, first_value(date) OVER w AS entry_date, first_value(close) OVER w AS entry_price FROM smooth WINDOW w AS (PARTITION BY tic, year(date) ORDER BY date)""")
view("breaches", """
SELECT tic, entry_date, date, entry_price, close, peak, fe, fp, kind, row_number() OVER (PARTITION BY tic, entry_date ORDER BY date) AS rn FROM (
  SELECT *, close / entry_price - 1 AS fe, close / peak - 1 AS fp, CASE WHEN close / entry_price - 1 <= -0.05 THEN 'absolute' WHEN close / peak - 1 <= -0.10 THEN 'trailing' END AS kind FROM (
    SELECT *, max(close) OVER (PARTITION BY tic, entry_date ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM positions) p) q WHERE kind IS NOT NULL""")
_STOPS = """
WITH RECURSIVE br AS MATERIALIZED (SELECT * FROM breaches),
sg AS (SELECT tic, entry_date, date, rn FROM br WHERE rn = 1
  UNION ALL SELECT tic, entry_date, nd, nr FROM (SELECT s.tic, s.entry_date, min(b.date) AS nd, min(b.rn) AS nr FROM sg s JOIN br b ON b.tic = s.tic AND b.entry_date = s.entry_date AND b.date >= s.date + 21 GROUP BY s.tic, s.entry_date) z)
"""


def positions(spark, sf):
    """A position per ticker and calendar year, entered on its first day."""
    w = Window.partitionBy("tic", F.year("date")).orderBy("date")
    return P.smooth(spark, sf).select("tic", "date", "close", F.first("date").over(w).alias("entry_date"), F.first("close").over(w).alias("entry_price"))


@query("stop_loss", _STOPS + f"""SELECT b.tic, b.entry_date, b.date, kind, {qcut('fe')} AS from_entry, {qcut('fp')} AS from_peak, b.date + 21 AS cooldown_until FROM sg JOIN br b USING (tic, entry_date, rn)""")
def stop_loss(spark, sf):
    d = B.stop_loss(positions(spark, sf))
    return d.select("tic", "entry_date", "date", "kind", cut(F.col("from_entry")).alias("from_entry"), cut(F.col("from_peak")).alias("from_peak"), "cooldown_until")


_QUIET = [("base", 10), ("long", 30)]


@query("decision_timeline", _STOPS + """, dy AS (SELECT s.date, s.date IN (SELECT date FROM week_ends) AS wk, s.trigger, s.date IN (SELECT date FROM sg) AS stop FROM shocks s),
ps AS (SELECT * FROM (VALUES ('base', 10), ('long', 30)) t(params, quiet)),
cd AS MATERIALIZED (SELECT date FROM dy WHERE trigger AND NOT wk),
fr AS (SELECT params, quiet, (SELECT min(date) FROM cd) AS date FROM ps
  UNION ALL SELECT params, quiet, nd FROM (SELECT f.params, f.quiet, min(c.date) AS nd FROM fr f JOIN cd c ON c.date > f.date + f.quiet GROUP BY 1, 2) z)
SELECT ps.params, dy.date, CASE WHEN wk THEN 'weekly' WHEN fr.date IS NOT NULL THEN 'fast_track_trigger' WHEN stop THEN 'stop_loss_trigger' ELSE 'none' END AS action
FROM dy CROSS JOIN ps LEFT JOIN fr ON fr.params = ps.params AND fr.date = dy.date""")
def decision_timeline(spark, sf):
    s = G.price_vol_shock(T.index_daily(spark, sf)).select("date", "trigger")
    stops = B.stop_loss(positions(spark, sf)).select("date").distinct().withColumn("stop", F.lit(True))
    wk = T.week_ends(spark, sf).withColumn("is_weekly", F.lit(True))
    days = s.join(stops, "date", "left").join(wk, "date", "left").na.fill(False, ["stop", "is_weekly"])
    return G.decision_timeline(days, _QUIET).select("params", "date", "action")


@query("equal_weights", f"SELECT date, tic, {qcut('weight')} AS weight FROM equal_weights")
def equal_weights(spark, sf):
    m = P.membership(spark, sf).withColumnRenamed("snap_date", "date")
    return B.equal_weights(m).select("date", "tic", cut(F.col("weight")).alias("weight"))


def _selected(spark, sf):
    from stratapanel.operators.ranking import quantile_select

    return quantile_select(bucket_preds(spark, sf), 0.75).select(F.col("datadate").alias("date"), "tic", "sector", "pred")


@query("min_variance_weights")
def min_variance_weights(spark, sf):
    prices = scratch.cut_lineage(P.quarter_closes(spark, sf), "quarters")
    return B.min_variance_weights(scratch.cut_lineage(_selected(spark, sf), "selected"), prices)


@query("min_variance_pair", f"""
WITH q AS (SELECT datadate, row_number() OVER (ORDER BY datadate) AS ord FROM (SELECT DISTINCT datadate FROM quarter_closes)),
p AS (SELECT DISTINCT ord AS t, q.datadate AS date FROM q JOIN bucket_preds USING (datadate)),
n AS (SELECT p.t, p.date, tic, row_number() OVER (PARTITION BY p.t ORDER BY md5(CAST(p.date AS VARCHAR) || tic)) AS k FROM p JOIN bucket_preds b ON b.datadate = p.date QUALIFY k <= 2),
x AS (SELECT n.t, n.date, n.tic, n.k, q.ord, price / lag(price) OVER (PARTITION BY n.t, n.tic ORDER BY q.ord) - 1 AS r
  FROM n JOIN q ON q.ord BETWEEN n.t - 7 AND n.t JOIN quarter_closes c ON c.datadate = q.datadate AND c.tic = n.tic),
j AS (SELECT t, date, ord, max(r) FILTER (WHERE k = 1) AS a, max(r) FILTER (WHERE k = 2) AS b FROM x GROUP BY ALL),
v AS (SELECT t, date, count(a) AS rows, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM j GROUP BY ALL),
w AS (SELECT t, CASE WHEN rows < 3 THEN 0.5 ELSE least(greatest((vb - c) / (va + vb - 2 * c), 0), 1) END AS w FROM v)
SELECT n.date, n.tic, {qcut('CASE WHEN k = 1 THEN w ELSE 1 - w END', 4)} AS weight FROM n JOIN w USING (t)""")
def min_variance_pair(spark, sf):
    """Two names of each date, picked by hash: the closed form is SQL's."""
    w = Window.partitionBy("datadate").orderBy(F.md5(F.concat(F.col("datadate").cast("string"), F.col("tic"))))
    two = bucket_preds(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 2")
    two = scratch.cut_lineage(two.select(F.col("datadate").alias("date"), "tic"), "pairs")
    prices = scratch.cut_lineage(P.quarter_closes(spark, sf), "quarters")
    return B.min_variance_weights(two, prices).withColumn("weight", cut(F.col("weight"), 4))


@query("allocate_weights")
def allocate_weights(spark, sf):
    s = scratch.cut_lineage(_selected(spark, sf), "selected")
    a = B.allocate_weights(s, "equal").withColumn("method", F.lit("equal"))
    return a.unionByName(B.allocate_weights(s, "min_variance", P.quarter_closes(spark, sf)).withColumn("method", F.lit("min_variance")))


@query("risk_caps", f"""
WITH w AS (SELECT date, tic, sector, least(weight * 2, 0.1::DOUBLE) AS w FROM equal_weights JOIN sectors USING (tic)), s AS (SELECT *, sum(w) OVER (PARTITION BY date, sector) AS s FROM w)
SELECT date, tic, sector, {qcut('w * least(1, 0.3::DOUBLE / s)')} AS weight FROM s""")
def risk_caps(spark, sf):
    w = P.equal_membership_weights(spark, sf).join(P.sectors(spark, sf), "tic").withColumn("weight", F.col("weight") * 2)
    return B.risk_caps(w).select("date", "tic", "sector", cut(F.col("weight")).alias("weight"))


@query("order_plan", f"""
WITH h AS (SELECT o_custkey AS account, 'S' || l_suppkey AS tic, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
t AS (SELECT account, tic, 1.0::DOUBLE / count(*) OVER (PARTITION BY account) AS w, CASE WHEN q > 20 THEN q / 100 END AS q FROM h),
p AS (SELECT tic, arg_max(close, date) AS p FROM smooth GROUP BY 1),
m AS (SELECT account, tic, p, abs(c_acctbal) * 100 AS v, abs(c_acctbal) * 100 * w - coalesce(q, 0) * p AS mv FROM t JOIN p USING (tic) JOIN customer ON c_custkey = account),
f AS (SELECT *, sum(abs(mv)) OVER (PARTITION BY account) / v AS r FROM m WHERE abs(mv) >= 100 AND abs(mv / p) >= 1 AND abs(mv) <= 100000)
SELECT account, tic, CASE WHEN mv > 0 THEN 'buy' ELSE 'sell' END AS side, {qcut('abs(mv / p) * CASE WHEN r > 0.5 THEN 0.5::DOUBLE / r ELSE 1 END')} AS quantity, p AS price FROM f""")
def order_plan(spark, sf):
    o, li = P.table(spark, sf, "orders"), P.table(spark, sf, "lineitem")
    h = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("account"), P.ticker("l_suppkey").alias("tic")).agg(F.sum("l_quantity").alias("q"))
    n = h.groupBy("account").agg(F.count("*").alias("n"))
    targets = h.join(n, "account").select("account", "tic", (1 / F.col("n")).alias("weight"))
    held = h.filter(F.col("q") > 20).select("account", "tic", (F.col("q") / 100).alias("quantity"))
    accounts = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), (F.abs("c_acctbal") * 100).alias("value"))
    px = P.smooth(spark, sf).groupBy("tic").agg(F.max_by("close", "date").alias("close"))
    return B.order_plan(targets, accounts, held, px).withColumn("quantity", cut(F.col("quantity")))


@query("latest_weights_normalise", f"""
WITH w AS (SELECT tic, sum(CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END) AS w FROM (SELECT 'S' || l_suppkey AS tic, p_size, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON p_partkey = l_partkey)
  WHERE d = (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) GROUP BY 1)
SELECT tic, {qcut('CAST(w AS DOUBLE) / (SELECT sum(w) FROM w WHERE w > 0)')} AS weight FROM w WHERE w > 0""")
def latest_weights_normalise(spark, sf):
    li = P.table(spark, sf, "lineitem").join(P.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    w = li.select(F.col("l_shipdate").cast("date").alias("date"), P.ticker("l_suppkey").alias("tic"),
                  F.when(F.col("p_size") % 7 == 0, -1.0).otherwise(F.col("p_size").cast("double")).alias("weight"))
    return B.latest_weights_normalise(w).withColumn("weight", cut(F.col("weight")))


@query("tsmom_signal", f"""
WITH m AS (SELECT tic, last_day(date) AS date, max_by(close, date) AS close FROM smooth GROUP BY 1, 2),
r AS (SELECT tic, date, lag(close) OVER w / lag(close, 12) OVER w - 1 AS ret FROM m WINDOW w AS (PARTITION BY tic ORDER BY date))
SELECT tic, date, {qcut('ret')} AS ret, CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS signal FROM r WHERE date >= DATE '1996-06-30'""")
def tsmom_signal(spark, sf):
    d = B.tsmom_signal(A.month_last_price(P.smooth(spark, sf)), start="1996-06-30")
    return d.withColumn("ret", cut(F.col("ret")))


def _month_events(cal):
    f = C.rebalance_day_flag(cal).filter("monthly")
    w = Window.partitionBy(F.trunc("date", "month")).orderBy("date")
    return f.withColumn("kind", F.when(F.row_number().over(w) == 1, "signal").otherwise("month_end")).select("date", "kind")


view("month_days", """
SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS k, count(*) OVER (PARTITION BY date_trunc('month', date)) AS n FROM calendar""")
view("daily_signal", """
SELECT u.date, u.tic, s.signal FROM universe_days u JOIN monthly_signal s ON s.tic = u.tic AND s.date = CAST(date_trunc('month', u.date) AS DATE)""")


def daily_signals(spark, sf, days):
    """Signals of the days that are asked for: every ticker has a row on each, so a whole calendar of them is large."""
    return J.signal_expand_to_daily(monthly_signal(spark, sf), days, "M", universe_days(spark, sf, days))


@query("monthly_target_weights", f"""
WITH e AS (SELECT date FROM month_days WHERE k = 2 OR n = 1), g AS (SELECT date, tic, signal FROM daily_signal JOIN e USING (date) WHERE signal <> 0 AND date < last_day((SELECT max(date) FROM monthly_signal)) QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(CAST(date AS VARCHAR) || tic), tic) <= 20),
s AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM g),
d AS (SELECT c.date, (SELECT max(date) FROM s WHERE s.date <= c.date) AS f FROM calendar c)
SELECT d.date, tic, {qcut('signal * least(0.2, greatest(0.05, 1.0::DOUBLE / n))')} AS weight FROM d JOIN s ON s.date = d.f""")
def monthly_target_weights(spark, sf):
    cal = P.calendar(spark, sf)
    events = _month_events(cal)
    # the picks of all days: read by each of their uses
    on = scratch.cut_lineage(daily_signals(spark, sf, events.filter("kind = 'signal'").select("date")), "signals")
    ev = scratch.cut_lineage(B.event_weights(on, events), "event-weights")
    return B.hold_daily(ev, cal).withColumn("weight", cut(F.col("weight")))


_STEP = [
    {"name": "weekly", "cooling": 5},
    {"name": "long_only", "allow_short": False, "gross": 0.8, "max_positions": 5},
]


@query("step_weights", f"""
WITH f AS (SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY year(date), week(date) ORDER BY date) AS wk FROM calendar) x WHERE wk = 1),
o AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM calendar),
c AS (SELECT date, (SELECT max(m.date) FROM monthly_signal m WHERE m.date <= calendar.date) AS start FROM calendar),
s AS (SELECT c.date, m.tic, m.signal FROM c JOIN monthly_signal m ON m.date = c.start WHERE c.date < last_day((SELECT max(date) FROM monthly_signal))),
d AS (SELECT s.date, o.ord, s.tic, s.signal, u.tic IS NOT NULL AS inside FROM s JOIN f USING (date) JOIN o USING (date) LEFT JOIN universe_days u ON u.date = s.date AND u.tic = s.tic),
p AS (SELECT * FROM (VALUES ('weekly', 5, true, 0.2::DOUBLE, 1.0::DOUBLE, 20), ('long_only', 0, false, 0.2::DOUBLE, 0.8::DOUBLE, 5)) v(params, cooling, short, most, lever, cap)),
a AS (SELECT p.*, d.*, CASE WHEN inside AND (short OR signal > 0) THEN sign(signal) ELSE 0 END AS sg FROM d, p),
b AS (SELECT *, coalesce(lag(sg) OVER (PARTITION BY params, tic ORDER BY ord), 0) AS before FROM a),
q AS (SELECT *, max(CASE WHEN sg = 0 AND before <> 0 THEN ord END) OVER (PARTITION BY params, tic ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM b),
e AS (SELECT *, CASE WHEN coalesce(ord < stopped + cooling, false) THEN 0 ELSE sg * most END AS want FROM q),
g AS (SELECT *, coalesce(lag(want) OVER (PARTITION BY params, tic ORDER BY ord), 0) AS held FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY params, date ORDER BY abs(want) DESC, tic) AS rn FROM g WHERE want <> 0),
k AS (SELECT *, sum(abs(want)) OVER (PARTITION BY params, date) AS gross FROM t WHERE rn <= cap)
SELECT params, date, tic, {qcut('want * least(1, lever / gross)')} AS weight,
  CASE WHEN held = 0 THEN CASE WHEN want > 0 THEN 'OPEN_LONG' ELSE 'OPEN_SHORT' END WHEN held <> want THEN 'FLIP' ELSE 'HOLD' END AS action FROM k""")
def step_weights(spark, sf):
    cal = P.calendar(spark, sf)
    flags = C.rebalance_day_flag(cal).select("date", F.col("weekly").alias("is_rebalance"))
    # weights change on rebalance days alone, so signals and universe are expanded to those
    on = flags.filter("is_rebalance").select("date")
    u = universe_days(spark, sf, on).withColumn("in_universe", F.lit(True))
    sig = J.signal_expand_to_daily(monthly_signal(spark, sf), on, "M").join(u, ["date", "tic"], "left")
    sig = sig.na.fill(False, ["in_universe"]).join(flags, "date").join(C.calendar_ordinals(cal), "date")
    d = B.step_weights(scratch.cut_lineage(sig, "daily-signals"), _STEP)
    return d.withColumn("weight", cut(F.col("weight")))
