"""Ranking, selection and exception queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import ranking as X
from stratapanel.plans import panel as P
from stratapanel.plans import rotation as T
from stratapanel.plans.cleaning_queries import buckets
from stratapanel.plans.feature_queries import _MEDL, bench_returns
from stratapanel.plans.registry import cut, long, qcut, query, view
from stratapanel.sources import scratch

_F12 = "OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
view("scores", f"""
WITH d AS (SELECT w.tic, w.sector, w.date, w.close, w.ret - g.ret AS x FROM weekly w JOIN group_weekly g USING (sector, date)),
a AS (SELECT tic, sector, date, close, x, count(*) {_F12} AS rows, median(x) {_F12} AS c, list(x) FILTER (WHERE x IS NOT NULL) {_F12} AS xs,
      product(1 + x) {_F12} - 1 AS rm FROM d),
m AS (SELECT *, {_MEDL} AS m FROM a)
SELECT tic, sector, date, close, x, rows >= 9.6 AS is_valid, CASE WHEN rows < 9.6 OR len(xs) < rows THEN 0
  WHEN m < 1e-6 THEN CASE WHEN abs(x - c) < 1e-6 THEN 0 ELSE 10 * sign(x - c) END ELSE greatest(least((x - c) / m, 20), -20) END AS zscore,
  CASE WHEN rows >= 9.6 THEN coalesce(rm, 0) ELSE 0 END AS residual_momentum FROM m""")
view("active_groups", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY information_ratio DESC, sector) AS rank FROM group_strength WHERE is_valid)
SELECT *, excess_return > 0 AND sum((excess_return > 0)::INT) OVER (PARTITION BY date ORDER BY rank) <= 2 AS is_active FROM r""")
view("top_assets", """
SELECT date, sector, tic, zscore, rank FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY zscore DESC, tic) AS rank FROM scores
  JOIN (SELECT date, sector FROM active_groups WHERE is_active) a USING (date, sector) WHERE is_valid) x WHERE rank <= 3""")


@query("intra_group_rank", f"""
SELECT tic, sector, date, {qcut('zscore', 4)} AS zscore, {qcut('residual_momentum')} AS residual_momentum,
       row_number() OVER (PARTITION BY date, sector ORDER BY zscore DESC, tic) AS rank FROM scores WHERE is_valid""")
def intra_group_rank(spark, sf):
    w = scratch.cut_lineage(T.weekly(spark, sf), "weekly")
    d = X.intra_group_rank(scratch.cut_lineage(X.asset_scores(w, T.group_returns(w)), "scores"))
    return d.select("tic", "sector", "date", cut(F.col("zscore"), 4).alias("zscore"), cut(F.col("residual_momentum")).alias("residual_momentum"), "rank")


@query("top_n_per_group", f"SELECT date, sector, tic, {qcut('zscore', 4)} AS zscore, rank FROM top_assets")
def top_n_per_group(spark, sf):
    d = T.decisions(spark, sf)["top"]
    return d.select("date", "sector", "tic", cut(F.col("zscore"), 4).alias("zscore"), "rank")


@query("rank_groups_select_active", f"""
SELECT date, sector, rank, is_active, {qcut('excess_return')} AS excess_return, {qcut('information_ratio')} AS information_ratio FROM active_groups""")
def rank_groups_select_active(spark, sf):
    d = T.decisions(spark, sf)["strength"]
    return d.select("date", "sector", "rank", "is_active", cut(F.col("excess_return")).alias("excess_return"), cut(F.col("information_ratio")).alias("information_ratio"))


view("bucket_preds", f"""
SELECT tic, datadate, sector, bucket, price, n, {qcut('pred', 3)} AS pred, {qcut('pred', 3)} AS bucket_pred, CASE WHEN n % 9 <> 0 THEN {qcut('pred2', 3)} END AS unified_pred, y_return
FROM predictions JOIN buckets USING (tic)""")


def bucket_preds(spark, sf):
    """Predictions cut to three digits (so that ties occur), with buckets and a unified model's view.

    Written once: ranks and quantiles read their table several times.
    """
    p = P.predictions(spark, sf).join(buckets(spark, sf), "tic")
    p = p.withColumns({"pred": cut(F.col("pred"), 3), "unified_pred": F.when(F.col("n") % 9 != 0, cut(F.col("pred2"), 3))})
    p = p.withColumn("bucket_pred", F.col("pred")).select(
        "tic", "datadate", "sector", "bucket", "price", "n", "pred", "bucket_pred", "unified_pred", "y_return"
    )
    return scratch.cut_lineage(p, "preds")


@query("quantile_select", """
WITH a AS (SELECT *, greatest(quantile_cont(pred, 0.75) OVER (PARTITION BY datadate), 0) AS thr, quantile_cont(pred, 0.75) OVER (PARTITION BY datadate, sector) AS sthr FROM bucket_preds)
SELECT 'all' AS rule, tic, datadate, sector, pred, """ + qcut("thr") + """ AS threshold FROM a WHERE pred >= thr AND pred > 0
UNION ALL SELECT 'sector', tic, datadate, sector, pred, """ + qcut("sthr") + " FROM a WHERE pred >= sthr")
def quantile_select(spark, sf):
    p = bucket_preds(spark, sf).select("tic", "datadate", "sector", "pred")
    a = X.quantile_select(p).withColumn("rule", F.lit("all"))
    s = X.quantile_select(p, keys=["datadate", "sector"], positive=False).withColumn("rule", F.lit("sector"))
    return a.unionByName(s).withColumn("threshold", cut(F.col("threshold")))


@query("bucket_select_strict_relaxed", """
WITH p AS (SELECT * FROM bucket_preds),
a AS (SELECT *, quantile_cont(pred, 0.75) OVER g AS thr, count(*) OVER g AS candidates FROM p WINDOW g AS (PARTITION BY datadate, bucket)),
b AS (SELECT *, count(*) FILTER (WHERE pred >= thr AND pred > 0) OVER (PARTITION BY datadate, bucket) AS st, row_number() OVER (PARTITION BY datadate, bucket ORDER BY pred DESC, tic) AS rk FROM a),
s AS (SELECT datadate, bucket, tic, pred, rk, thr, candidates, CASE WHEN st >= 7 THEN 'strict_quantile' ELSE 'relaxed_topk' END AS mode, least(candidates, 7) AS selected FROM b WHERE rk <= 7),
g AS (SELECT d.datadate, u.bucket FROM (SELECT DISTINCT datadate FROM p) d, (SELECT unnest(['growth_tech', 'cyclical', 'real_assets', 'defensive', 'unlisted']) AS bucket) u)
SELECT g.datadate, g.bucket, s.tic, s.pred, s.rk AS bucket_rank, """ + qcut("s.thr") + """ AS threshold, coalesce(s.candidates, 0) AS candidates, coalesce(s.selected, 0) AS selected, coalesce(s.mode, 'no_candidates') AS mode
FROM g LEFT JOIN s USING (datadate, bucket)""")
def bucket_select_strict_relaxed(spark, sf):
    p = bucket_preds(spark, sf)
    s = X.bucket_select_strict_relaxed(p)
    summary = X.bucket_selection_summary(s, p.select("datadate").distinct(), (*X.BUCKETS, "unlisted"))
    rows = s.select("datadate", "bucket", "tic", "pred", "bucket_rank", cut(F.col("threshold")).alias("threshold"))
    return summary.join(rows, ["datadate", "bucket"], "left")


_RANKS = """
WITH a AS (SELECT *, count(pred) OVER g AS n_g, rank() OVER (PARTITION BY bucket, datadate ORDER BY pred DESC) + (count(*) OVER (PARTITION BY bucket, datadate, pred) - 1) / 2.0::DOUBLE AS r FROM bucket_preds WINDOW g AS (PARTITION BY bucket, datadate))"""


@query("rank_within_bucket", _RANKS + f" SELECT tic, bucket, datadate, CAST(floor(r) AS BIGINT) AS rank_best, {qcut('(n_g + 1 - r) / n_g')} AS pct FROM a")
def rank_within_bucket(spark, sf):
    d = X.rank_within_bucket(bucket_preds(spark, sf), "pred", ["bucket", "datadate"], "rank_best", "pct")
    return d.select("tic", "bucket", "datadate", "rank_best", cut(F.col("pct")).alias("pct"))


def _avg_rank(x, keys):
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {x} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE END)"


view("pctiles", f"""
SELECT *, (count(bucket_pred) OVER (PARTITION BY bucket, datadate) + 1 - {_avg_rank('bucket_pred', 'bucket, datadate')}) / count(bucket_pred) OVER (PARTITION BY bucket, datadate) AS bp,
       (count(unified_pred) OVER (PARTITION BY bucket, datadate) + 1 - {_avg_rank('unified_pred', 'bucket, datadate')}) / count(unified_pred) OVER (PARTITION BY bucket, datadate) AS up
FROM bucket_preds""")
view("dual", f"""
SELECT *, CAST(floor({_avg_rank('score', 'alpha, bucket, datadate')}) AS BIGINT) AS rank FROM (
  SELECT p.*, alpha, alpha * up + (1 - alpha) * bp AS score FROM pctiles p, (SELECT unnest([0.0::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS alpha) a) s""")


@query("dual_ensemble", f"SELECT tic, bucket, datadate, alpha, {qcut('score')} AS score, rank FROM dual")
def dual_ensemble(spark, sf):
    d = X.dual_ensemble(bucket_preds(spark, sf))
    return d.select("tic", "bucket", "datadate", "alpha", cut(F.col("score")).alias("score"), "rank")


@query("mixed_alpha", f"""
WITH s AS (SELECT *, alpha * up + (1 - alpha) * bp AS ms, 0.5::DOUBLE * up + 0.5::DOUBLE * bp AS us FROM (SELECT *, CASE bucket WHEN 'growth_tech' THEN 0.0 WHEN 'cyclical' THEN 0.7 ELSE 1.0 END::DOUBLE AS alpha FROM pctiles) q)
SELECT tic, bucket, datadate, alpha, {qcut('ms')} AS mixed_score, CAST(floor({_avg_rank('ms', 'bucket, datadate')}) AS BIGINT) AS rank_mixed, {qcut('us')} AS uniform_score, CAST(floor({_avg_rank('us', 'bucket, datadate')}) AS BIGINT) AS rank_uniform FROM s""")
def mixed_alpha(spark, sf):
    d = X.mixed_alpha(bucket_preds(spark, sf))
    return d.select("tic", "bucket", "datadate", "alpha", cut(F.col("mixed_score")).alias("mixed_score"), "rank_mixed", cut(F.col("uniform_score")).alias("uniform_score"), "rank_uniform")


@query("alpha_sensitivity", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY alpha, bucket, datadate ORDER BY rank, tic) AS rn FROM dual WHERE rank IS NOT NULL),
g AS (SELECT alpha, bucket, datadate, avg(y_return) AS m FROM t WHERE rn <= 5 GROUP BY 1, 2, 3), o AS (SELECT alpha, avg(m) AS top_avg FROM g GROUP BY 1)
SELECT alpha, {qcut('top_avg')} AS top_avg, {qcut('(SELECT avg(y_return) FROM bucket_preds)')} AS proxy, {qcut('top_avg - (SELECT avg(y_return) FROM bucket_preds)')} AS excess FROM o""")
def alpha_sensitivity(spark, sf):
    d = X.alpha_sensitivity(X.dual_ensemble(bucket_preds(spark, sf)))
    return d.select("alpha", *(cut(F.col(c)).alias(c) for c in ("top_avg", "proxy", "excess")))


@query("latest_prediction", "SELECT tic, max(datadate) AS datadate, arg_max(bucket, datadate) AS bucket, arg_max(pred, datadate) AS pred FROM bucket_preds GROUP BY 1")
def latest_prediction(spark, sf):
    return X.latest_prediction(bucket_preds(spark, sf)).select("tic", "datadate", "bucket", "pred")


view("zs", f"SELECT tic, date, close, zscore AS z FROM scores WHERE is_valid")
_F4 = "OVER (PARTITION BY tic ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
view("mk", f"""
SELECT tic, date, close, z, CASE WHEN count(*) {_F4} = 4 THEN CAST(sum((z > 2.5)::INT) {_F4} AS BIGINT) ELSE 0 END AS trigger_count,
  CASE WHEN count(*) {_F4} = 4 THEN coalesce(array_to_string(list(CAST(date AS VARCHAR)) FILTER (WHERE z > 2.5) {_F4}, ','), '') ELSE '' END AS trigger_dates FROM zs""")


def weekly_z(spark, sf, daily=None):
    w = scratch.cut_lineage(T.weekly(spark, sf, daily), "weekly")
    return z_of(scratch.cut_lineage(X.asset_scores(w, T.group_returns(w)), "scores"))


def z_of(scores):
    return scores.filter("is_valid").select("tic", "date", "close", F.col("zscore").alias("z"))


def _dates_text(d):
    return d.withColumn("trigger_dates", F.concat_ws(",", F.transform("trigger_dates", lambda x: x.cast("string"))))


@query("exception_mk", f"SELECT tic, date, {qcut('z', 4)} AS z, trigger_count, trigger_dates, trigger_count >= 2 AS mk FROM mk")
def exception_mk(spark, sf):
    d = _dates_text(X.exception_mk(weekly_z(spark, sf))).drop("close").withColumn("z", cut(F.col("z"), 4))
    return d.withColumn("trigger_count", long(F.col("trigger_count")))


view("strong", """
WITH b AS (SELECT date, close / lag(close, 11) OVER (ORDER BY date) - 1 AS br FROM bench_weekly),
a AS (SELECT tic, date, z, close / lag(close, 11) OVER (PARTITION BY tic ORDER BY date) - 1 AS ar FROM zs),
j AS (SELECT * FROM a LEFT JOIN b USING (date))
SELECT *, coalesce(z >= 3.5 AND ar > 1.5::DOUBLE * br AND ar > 0, false) AS strong, CASE WHEN z < 3.5 THEN 'score' WHEN ar IS NULL OR br IS NULL THEN 'data' WHEN ar <= 0 THEN 'negative' WHEN ar <= 1.5::DOUBLE * br THEN 'benchmark' ELSE 'qualified' END AS reason FROM j""")


@query("exception_strong_signal", f"SELECT tic, date, {qcut('z', 4)} AS z, {qcut('ar')} AS asset_ret, {qcut('br')} AS bench_ret, strong, reason FROM strong")
def exception_strong_signal(spark, sf):
    daily = T.daily_panel(spark, sf)
    d = X.exception_strong_signal(weekly_z(spark, sf, daily), T.bench_weekly(spark, sf, daily).select("date", "close")).drop("close")
    return d.select("tic", "date", cut(F.col("z"), 4).alias("z"), cut(F.col("asset_ret")).alias("asset_ret"), cut(F.col("bench_ret")).alias("bench_ret"), "strong", "reason")


@query("exception_candidates", """
WITH q AS (SELECT tic, date, mk.z, trigger_count, trigger_dates, trigger_count >= 2 AS m, strong FROM mk JOIN strong USING (tic, date) WHERE tic IN (SELECT tic FROM membership))
SELECT tic, date, """ + qcut("z", 4) + """ AS z, trigger_count, trigger_dates, strong, m OR strong AS qualifies,
  CASE WHEN m OR strong THEN row_number() OVER (PARTITION BY date, m OR strong ORDER BY z DESC, tic) END AS place FROM q""")
def exception_candidates(spark, sf):
    daily = T.daily_panel(spark, sf)
    z = weekly_z(spark, sf, daily)
    d = X.exception_candidates(z, T.bench_weekly(spark, sf, daily).select("date", "close"), P.membership(spark, sf))
    d = _dates_text(d).withColumn("trigger_count", long(F.col("trigger_count")))
    return d.select("tic", "date", cut(F.col("z"), 4).alias("z"), "trigger_count", "trigger_dates", "strong", "qualifies", "place")


@query("quantile_buckets", """
WITH q AS (SELECT datadate, quantile_cont(pred, 0.25) AS q25, quantile_cont(pred, 0.3) AS q30, quantile_cont(pred, 0.5) AS q50, quantile_cont(pred, 0.7) AS q70, quantile_cont(pred, 0.75) AS q75 FROM predictions GROUP BY 1)
SELECT tic, datadate, CASE WHEN pred <= q25 THEN 1 WHEN pred <= q50 THEN 2 WHEN pred <= q75 THEN 3 ELSE 4 END::BIGINT AS quarter, pred <= q30 AS low_30, pred >= q70 AS high_70 FROM predictions JOIN q USING (datadate)""")
def quantile_buckets(spark, sf):
    return X.quantile_buckets(P.predictions(spark, sf).select("tic", "datadate", "pred")).select("tic", "datadate", "quarter", "low_30", "high_70")


view("smooth_ret", "SELECT tic, date, close, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret FROM smooth")


def smooth_returns(spark, sf):
    from stratapanel.operators.features import simple_return

    d = P.smooth(spark, sf).select("tic", "date", "close", simple_return(F.col("close")).alias("ret"))
    return scratch.cut_lineage(d, "returns")


@query("bucket_top5_tracking", f"""
WITH p AS (SELECT tic, datadate, bucket FROM (SELECT *, row_number() OVER (PARTITION BY datadate, bucket ORDER BY pred DESC, tic) AS rn FROM bucket_preds) x WHERE rn <= 5),
h AS (SELECT p.datadate, p.bucket, r.date, avg(ret) AS ret FROM p JOIN smooth_ret r ON r.tic = p.tic AND r.date > p.datadate AND r.date <= last_day(CAST(p.datadate + INTERVAL 1 DAY + INTERVAL 2 MONTH AS DATE)) WHERE ret IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT * FROM h UNION ALL SELECT datadate, 'portfolio', date, avg(ret) FROM h GROUP BY 1, 3),
j AS (SELECT u.*, b.bret FROM u JOIN bench_ret b USING (date) WHERE bret IS NOT NULL),
c AS (SELECT datadate, bucket, date, product(1 + ret) OVER w - 1 AS c, product(1 + bret) OVER w - 1 AS b FROM j WINDOW w AS (PARTITION BY datadate, bucket ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT datadate, bucket, date, {qcut('c')} AS cumulative, {qcut('b')} AS bench_cumulative, {qcut('c - b')} AS alpha FROM c""")
def bucket_top5_tracking(spark, sf):
    d = X.bucket_top5_tracking(bucket_preds(spark, sf), smooth_returns(spark, sf), bench_returns(spark, sf))
    return d.select("datadate", "bucket", "date", *(cut(F.col(c)).alias(c) for c in ("cumulative", "bench_cumulative", "alpha")))
