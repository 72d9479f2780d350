"""Model training and user-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import backtest as Q
from stratapanel.operators import models as M
from stratapanel.operators import moments as R
from stratapanel.operators import ranking as X
from stratapanel.operators import user as U
from stratapanel.plans import panel as P
from stratapanel.plans.backtest_queries import priced
from stratapanel.plans.cleaning_queries import buckets, day_returns
from stratapanel.plans.feature_queries import sector_weekly
from stratapanel.plans.metric_queries import sector_daily
from stratapanel.plans.ranking_queries import bucket_preds
from stratapanel.plans.registry import cut, qcut, query
from stratapanel.sources import scratch

CUTOFF = "2000-12-31"
FEATURES = ("revenue", "net_revenue", "shares", "price", "pred", "pred2")
MOMENTUM = ("ret_1q", "ret_4q", "eps_chg", "roe_chg", "gm_chg", "ret_accel")
# What was trained in this application: folder and tables by (application, tables, what). Each model is fitted once.
_TRAINED: dict[tuple, tuple] = {}
SIZES: dict[str, int] = {}  # of candidate_models; empty: the full ones


def dataset(spark, sf):
    return scratch.cut_lineage(P.predictions(spark, sf).join(buckets(spark, sf), "tic"), "dataset")


@query("split_val_quarters", """
WITH q AS (SELECT datadate, row_number() OVER (ORDER BY datadate DESC) AS k FROM (SELECT DISTINCT datadate FROM predictions WHERE y_return IS NOT NULL AND datadate <= DATE '2000-12-31') d)
SELECT tic, datadate, CASE WHEN datadate > DATE '2000-12-31' THEN 'infer' WHEN y_return IS NULL THEN NULL WHEN k <= 3 THEN 'val' ELSE 'train' END AS role FROM predictions LEFT JOIN q USING (datadate)""")
def split_val_quarters(spark, sf):
    return M.split_val_quarters(P.predictions(spark, sf), CUTOFF).select("tic", "datadate", "role")


def factors(spark, sf):
    """The rows that models are trained on: factors, momentum, sector, bucket, label."""
    from stratapanel.operators.features import momentum_features as momentum

    p = P.predictions(spark, sf)
    m = momentum(p.select(
        "tic", "datadate", F.col("price").alias("trade_price"), (F.col("net_revenue") / F.col("shares")).alias("eps"), "pred", "pred2"
    ), {"eps": "eps_chg", "pred": "roe_chg", "pred2": "gm_chg"})
    d = p.join(m.select("tic", "datadate", *MOMENTUM), ["tic", "datadate"]).join(buckets(spark, sf), "tic")
    return scratch.cut_lineage(d, "factors")


def _once(spark, sf, what, make):
    key = (spark.sparkContext.applicationId, sf, what, tuple(sorted(SIZES.items())))
    if key not in _TRAINED:
        _TRAINED[key] = make()
    return _TRAINED[key]


def _trained(spark, sf, unified=False):
    """(predictions, models, folder) of the bucket models, or of one model for all stocks."""
    def make():
        folder = scratch.new_path(spark, "fitted")
        d, names = factors(spark, sf), X.BUCKETS
        if unified:
            d, names = d.withColumn("bucket", F.lit("unified")), ["unified"]
        p, m = M.bucket_models(d, [*FEATURES, *MOMENTUM], names, CUTOFF, folder, sizes_of=SIZES, flags="sector")
        return p, m, folder

    return _once(spark, sf, "unified" if unified else "buckets", make)


@query("sector_flags", """
WITH s AS (SELECT DISTINCT bucket, sector FROM predictions JOIN buckets USING (tic))
SELECT tic, datadate, bucket, 'sector_' || s.sector AS feature, CAST(p.sector = s.sector AS DOUBLE) AS value
FROM predictions p JOIN buckets USING (tic) JOIN s USING (bucket)""")
def sector_flags(spark, sf):
    """The 0/1 features of each bucket's models: only sectors that the bucket has."""
    from pyspark.ml.functions import vector_to_array

    d, out = dataset(spark, sf), None
    for b in X.BUCKETS:  # four of them
        own, labels = M.with_flags(d.filter(F.col("bucket") == b), "sector")
        values = vector_to_array("sector_flags")
        flags = F.explode(F.array(*(
            F.struct(F.lit(n).alias("feature"), F.get(values, F.lit(i)).alias("value")) for i, n in enumerate(labels)
        ))).alias("f")
        part = own.select("tic", "datadate", "bucket", flags).select("tic", "datadate", "bucket", "f.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("bucket_models")
def bucket_models(spark, sf):
    p, m, _ = _trained(spark, sf)
    return M.best_predictions(p, m).join(M.inverse_mse_ensemble(p, m), ["bucket", "tic", "datadate"])


@query("feature_importance")
def feature_importance(spark, sf):
    _, m, folder = _trained(spark, sf)
    return M.rank_importance(M.saved_importances(m, folder))


@query("unified_model")
def unified_model(spark, sf):
    p, m, _ = _trained(spark, sf, unified=True)
    return X.rank_within_bucket(M.best_predictions(p, m), "pred", ["datadate"], "rank")


@query("stacking")
def stacking(spark, sf):
    p, m, _ = _trained(spark, sf)
    return p.join(m, ["bucket", "model"]).filter(F.col("model") == "stacking").select("bucket", "tic", "datadate", "pred", "val_mse")


@query("inverse_mse_ensemble", f"""
WITH p AS (SELECT bucket, tic, datadate, unnest(['first', 'second', 'mean']) AS model, unnest([pred, pred2, (pred + pred2) / 2]) AS p FROM predictions JOIN buckets USING (tic)),
w AS (SELECT bucket, model, CASE WHEN round(val_mse, 6) > 0 THEN 1 / round(val_mse, 6) ELSE 0 END AS w FROM model_table)
SELECT bucket, tic, datadate, {qcut('sum(w * p) / sum(w)')} AS ensemble FROM p JOIN w USING (bucket, model) GROUP BY 1, 2, 3""")
def inverse_mse_ensemble(spark, sf):
    d = P.predictions(spark, sf).join(buckets(spark, sf), "tic").withColumns(
        {"first": F.col("pred"), "second": F.col("pred2"), "mean": (F.col("pred") + F.col("pred2")) / 2}
    )
    long = scratch.cut_lineage(
        d.unpivot(["bucket", "tic", "datadate", "y_return"], ["first", "second", "mean"], "model", "pred"), "models"
    )
    e = F.col("y_return") - F.col("pred")
    m = long.filter(F.col("y_return").isNotNull()).groupBy("bucket", "model").agg(F.avg(e * e).alias("val_mse"))
    return M.inverse_mse_ensemble(long, m).withColumn("ensemble", cut(F.col("ensemble")))


def _quarters(d):
    """All quarter ends that have rows, oldest first: each is one model run, so the list is short."""
    return [str(r[0]) for r in d.select("datadate").distinct().orderBy("datadate").collect()]


def _trade_quarters(d, train=16, test=4):
    """Quarters with a whole train and test window before them."""
    return _quarters(d)[train + test:]


def _ridge_sql(features, train, test, group=""):
    """Every window's ridge by its own rows: medians, standardised columns, normal equations, elimination."""
    n = len(features)
    keys = f"t, {group}" if group else "t"
    own = f"{group}, " if group else ""
    idx = range(1, n + 1)
    cells = ", ".join(
        "[" + ", ".join(f"sum(z[{i}] * z[{j}])" + (" + 1" if i == j else "") for j in idx) + f", sum(z[{i}] * (y - yb))]" for i in idx
    )
    return f"""
WITH RECURSIVE q AS (SELECT datadate, row_number() OVER (ORDER BY datadate) AS ord FROM (SELECT DISTINCT datadate FROM predictions)),
r AS (SELECT * FROM predictions JOIN q USING (datadate)),
w AS (SELECT q.ord AS t, r.*, r.ord >= q.ord - {test} AS tested FROM q JOIN r ON r.ord BETWEEN q.ord - {train + test} AND q.ord - 1 WHERE q.ord > {train + test} AND y_return IS NOT NULL),
md AS (SELECT {keys}, {", ".join(f"median({f}) AS m{i}" for i, f in enumerate(features, 1))} FROM w WHERE NOT tested GROUP BY {keys}),
f AS (SELECT {keys}, tested, y_return AS y, [{", ".join(f"coalesce({f}, m{i})::DOUBLE" for i, f in enumerate(features, 1))}] AS x FROM w JOIN md USING ({keys})),
st AS (SELECT {keys}, avg(y) AS yb, [{", ".join(f"avg(x[{i}])" for i in idx)}] AS a, [{", ".join(f"stddev_samp(x[{i}])" for i in idx)}] AS s FROM f WHERE NOT tested GROUP BY {keys} HAVING count(*) >= 10),
z AS (SELECT {keys}, tested, y, yb, [{", ".join(f"(x[{i}] - a[{i}]) / s[{i}]" for i in idx)}] AS z FROM f JOIN st USING ({keys})),
g AS (SELECT {keys}, 0 AS k, [{cells}] AS m FROM z WHERE NOT tested GROUP BY {keys}
  UNION ALL SELECT {keys}, k + 1, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j:
    CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM g WHERE k < {n}),
b AS (SELECT {keys}, list_transform(m, lambda x: x[{n + 1}]) AS b FROM g WHERE k = {n}),
e AS (SELECT {keys}, avg((y - yb - list_dot_product(z, b)) ** 2) AS mse FROM z JOIN b USING ({keys}) WHERE tested GROUP BY {keys})
SELECT tic, datadate, {own}{qcut("yb + list_dot_product([" + ", ".join(f"(coalesce({f}, m{i}) - a[{i}]) / s[{i}]" for i, f in enumerate(features, 1)) + "], b)")} AS pred, {qcut("mse")} AS model_mse
FROM (SELECT *, ord AS t FROM r) r JOIN md USING ({keys}) JOIN st USING ({keys}) JOIN b USING ({keys}) JOIN e USING ({keys})"""


def _ridges(spark, sf, group=()):
    d = scratch.cut_lineage(P.predictions(spark, sf), "panel")
    p = R.ridge_predictions(d, R.window_ridges(d, FEATURES, group=group), FEATURES, group)
    return p.select("tic", "datadate", *group, cut(F.col("pred")).alias("pred"), cut(F.col("model_mse")).alias("model_mse"))


@query("rolling_ridge", _ridge_sql(FEATURES, 16, 4))
def rolling_ridge(spark, sf):
    return _ridges(spark, sf)


@query("rolling_ridge_by_sector", _ridge_sql(FEATURES, 16, 4, "sector"))
def rolling_ridge_by_sector(spark, sf):
    return _ridges(spark, sf, ["sector"])


@query("rolling_train_single")
def rolling_train_single(spark, sf):
    return _single(spark, sf).withColumn("model_errors", F.to_json("model_errors"))


def _single(spark, sf):
    def make():
        d = dataset(spark, sf)
        return M.rolling_train_single(d, FEATURES, _quarters(d)[-1], sizes_of=SIZES)

    return _once(spark, sf, "single", make)


def _rolling(spark, sf):
    """Predictions of every trade quarter by its best model."""
    def make():
        d = dataset(spark, sf)
        return M.rolling_train_all(d, FEATURES, _trade_quarters(d), sizes_of=SIZES)

    return _once(spark, sf, "rolling", make)


@query("rolling_train_all")
def rolling_train_all(spark, sf):
    return _rolling(spark, sf).withColumn("model_errors", F.to_json("model_errors"))


@query("strategy_weights")
def strategy_weights(spark, sf):
    """Single mode with the same-day adjustment and rolling mode, each with both allocations; metadata beside."""
    sectors, prices = P.sectors(spark, sf), scratch.cut_lineage(P.quarter_closes(spark, sf), "quarters")
    daily = P.smooth(spark, sf).select("tic", "date", "close")
    out = None
    for mode, preds in (("single", _single(spark, sf)), ("rolling", _rolling(spark, sf))):
        p = scratch.cut_lineage(preds.drop("model_errors").join(sectors, "tic"), mode)
        day = {"gap_prices": daily, "execution": str(p.agg(F.max("datadate")).first()[0])} if mode == "single" else {}
        told = p.groupBy(F.col("datadate").alias("date")).agg(F.first("model").alias("model"), F.first("model_mse").alias("model_mse"))
        for method in ("equal", "min_variance"):
            w = M.strategy_weights(p, method=method, prices=prices, **day).join(told, "date")
            w = w.withColumns({"mode": F.lit(mode), "method": F.lit(method)})
            out = w if out is None else out.unionByName(w)
    return out


@query("ridge_strategy_weights", f"""
WITH p AS (SELECT tic, datadate, pred, sector FROM (""" + _ridge_sql(FEATURES, 16, 4).strip() + f""") x JOIN sectors USING (tic)),
a AS (SELECT *, greatest(quantile_cont(pred, 0.75) OVER (PARTITION BY datadate), 0) AS thr FROM p), s AS (SELECT * FROM a WHERE pred >= thr AND pred > 0),
w AS (SELECT *, least(0.1::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY datadate)) AS w FROM s)
SELECT datadate AS date, tic, sector, pred, {qcut('w * least(1, 0.3::DOUBLE / sum(w) OVER (PARTITION BY datadate, sector))')} AS weight FROM w""")
def ridge_strategy_weights(spark, sf):
    """The rolling mode with the ridge alone, equal weights."""
    p = scratch.cut_lineage(_ridges(spark, sf).join(P.sectors(spark, sf), "tic"), "ridge")
    w = M.strategy_weights(p)
    return w.select("date", "tic", "sector", "pred", cut(F.col("weight")).alias("weight"))


@query("sector_neutral_weights")
def sector_neutral_weights(spark, sf):
    def make():
        d = dataset(spark, sf)
        names = [r[0] for r in d.groupBy("sector").count().filter(F.col("count") >= 20).orderBy("sector").collect()]
        trades = _trade_quarters(d)

        # the sector list is short: one model family for each
        own = {s: scratch.cut_lineage(d.filter(F.col("sector") == s), "sector") for s in names}
        each = M.rolling_train_each(own, FEATURES, trades, sizes_of=SIZES)
        parts = [p.withColumn("sector", F.lit(s)) for s, p in each.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return scratch.cut_lineage(out.drop("model_errors"), "sectors")

    return M.strategy_weights(_once(spark, sf, "sectors", make), sector=True)


@query("rolling_date_windows", f"""
WITH w AS (SELECT DISTINCT datadate AS trade_date, datadate - 365 AS train_start, datadate - 91 AS test_start FROM quarter_closes),
g AS (SELECT w.trade_date, train_start, test_start, s.name, product(1 + s.ret) - 1 AS r FROM w JOIN series_stats s ON s.date >= w.test_start AND s.date < w.trade_date WHERE ret IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT trade_date, train_start, test_start, name, {qcut('r')} AS ret, row_number() OVER (PARTITION BY trade_date ORDER BY r DESC, name) = 1 AS is_best FROM g""")
def rolling_date_windows(spark, sf):
    from stratapanel.operators.metrics import series_returns

    w = M.rolling_date_windows(P.quarter_closes(spark, sf).select(F.col("datadate").alias("date")).distinct(), 365, 91)
    c = M.compare_model_returns(w, series_returns(sector_daily(spark, sf)).select("name", "date", "ret"))
    return c.join(w, "trade_date").select("trade_date", "train_start", "test_start", "name", cut(F.col("ret")).alias("ret"), "is_best")


@query("strategy_callable", f"""
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM sector_weekly) q)
SELECT p.date AS decision_date, s.name, {qcut('avg(s.close)', 4)} AS level, NULL::VARCHAR AS error
FROM d p JOIN d q ON q.ord BETWEEN p.ord - 9 AND p.ord JOIN sector_weekly s ON s.date = q.date WHERE p.ord >= 52 GROUP BY 1, 2
UNION ALL SELECT date, NULL, NULL, 'not enough data before' FROM d WHERE ord < 52""")
def strategy_callable(spark, sf):
    import pandas as pd

    s = scratch.cut_lineage(sector_weekly(spark, sf), "series")
    periods = Q.walk_forward_periods(s.select("date"), s.select("date"), 52, "rolling", 10)

    def mean_level(key, rows):
        return pd.DataFrame({"decision_date": [key[0]], "name": [key[1]], "level": [rows["close"].mean()]})

    d = Q.walk_forward_run(periods, s, mean_level, "decision_date date, name string, level double", by=["name"])
    return d.withColumn("level", cut(F.col("level"), 4))


@query("signal_per_ticker", """
SELECT tic, date, CASE WHEN close > max(close) OVER w THEN 1 WHEN close < min(close) OVER w THEN -1 ELSE 0 END::BIGINT AS signal
FROM prices WINDOW w AS (PARTITION BY tic ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def signal_per_ticker(spark, sf):
    def breakout(pdf):
        before = pdf["close"].shift(1).rolling(20, min_periods=1)
        up, down = pdf["close"] > before.max(), pdf["close"] < before.min()
        return pdf.assign(signal=up.astype("int64") - down.astype("int64"))[["tic", "date", "signal"]]

    return U.signal_per_ticker(P.prices(spark, sf).select("tic", "date", "close"), breakout, "tic string, date date, signal long")


@query("window_function_udf", f"""
SELECT tic, date, {qcut("CASE WHEN count(ret) OVER w = 20 THEN max(ret) OVER w - min(ret) OVER w END")} AS spread FROM day_returns WINDOW w AS (PARTITION BY tic ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def window_function_udf(spark, sf):
    r = day_returns(spark, sf).select("tic", "date", "ret")
    d = U.window_function(r, "ret", 20, lambda w: w.max() - w.min(), "spread", many=True)
    return d.select("tic", "date", cut(F.col("spread")).alias("spread"))


@query("weights_contract", f"""
WITH a AS (SELECT *, greatest(quantile_cont(pred, 0.75) OVER (PARTITION BY datadate), 0) AS thr FROM bucket_preds), s AS (SELECT datadate, tic, sector FROM a WHERE pred >= thr AND pred > 0),
w AS (SELECT *, least(0.1::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY datadate)) AS w FROM s)
SELECT datadate AS date, tic, {qcut('w * least(1, 0.3::DOUBLE / sum(w) OVER (PARTITION BY datadate, sector))')} AS weight FROM w""")
def weights_contract(spark, sf):
    p = bucket_preds(spark, sf).select("tic", "datadate", "sector", "pred")
    return U.run_strategy(M.strategy_weights, p).withColumn("weight", cut(F.col("weight")))


@query("cost_callable", f"SELECT strategy, {qcut('ln(sum(traded * 0.002::DOUBLE + 1))')} AS log_cost FROM priced GROUP BY 1")
def cost_callable(spark, sf):
    d = Q.total_costs(priced(spark, sf), lambda value, sigma, share: value * 0.002 + 1)
    return d.select("strategy", cut(F.ln("cost")).alias("log_cost"))
