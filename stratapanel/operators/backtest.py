"""Vectorised back-tests, trading costs and walk-forward runs.

A back-test is column arithmetic on long tables keyed by (strategy, date, tic): one plan for all
strategies. Only held names have rows, so the dates x tickers grid is never built; a name
without a price on a day did not move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions.order_stats import grouped_quantiles
from stratapanel.operators import calendar as C
from stratapanel.operators import joins as J
from stratapanel.sources.scratch import cut_lineage

KEYS = ("strategy", "date")


def weight_alignment(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Weights moved to the next trading day, names not priced yet dropped, rescaled to 1.

    Trading days are the dates of the price table. Of two weight dates that meet on one trading
    day the later one counts.
    """
    w = weights.groupBy("date", "tic").agg(F.sum("weight").alias("weight"))
    total = w.groupBy("date").agg(F.sum("weight").alias("_t")).filter(F.col("_t") > 0)
    days = prices.select(F.col("date").alias("_day"), F.lit(1).alias("_k")).distinct()
    at = J.asof_join(total.select("date", F.lit(1).alias("_k")), days, ["_k"], "date", "_day", ["_day"], "forward")
    at = at.filter(F.col("_day").isNotNull()).groupBy("_day").agg(F.max("date").alias("date"))
    first = prices.groupBy("tic").agg(F.min("date").alias("_first"))
    d = w.join(at, "date").join(first, "tic").filter(F.col("_first") <= F.col("_day"))
    s = d.groupBy("_day").agg(F.sum("weight").alias("_s")).filter(F.col("_s") > 0)
    return d.join(s, "_day").select(F.col("_day").alias("date"), "tic", (F.col("weight") / F.col("_s")).alias("weight"))


def weight_ffill_normalise(weights: DataFrame, days: DataFrame, keep_cash: bool = False) -> DataFrame:
    """Latest weights held on every trading day, rescaled to 1 (unless cash is kept)."""
    w = weights if "strategy" in weights.columns else weights.withColumn("strategy", F.lit("strategy"))
    w = w.filter(F.col("weight") != 0)
    starts = w.select("strategy", F.col("date").alias("_from")).distinct()
    names = starts.select("strategy").distinct()
    # Strategies are few: every one needs every day.
    grid = days.select("date").distinct().withColumn(
        "strategy", F.explode(names.agg(F.collect_set("strategy")).scalar())
    )
    d = J.asof_join(grid, starts, ["strategy"], "date", "_from", ["_from"]).filter(F.col("_from").isNotNull())
    # Weights are rescaled once for each of their dates and sent to where their days are listed: rows are only
    # multiplied after the last exchange.
    if not keep_cash:
        t = w.groupBy(*KEYS).agg(F.sum("weight").alias("_t"))
        w = w.join(t, list(KEYS)).withColumn(
            "weight", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(F.col("weight"))
        )
    held = d.groupBy("strategy", "_from").agg(F.collect_list("date").alias("_days"))
    w = w.select("strategy", F.col("date").alias("_from"), "tic", "weight")
    return w.join(held, ["strategy", "_from"]).select("strategy", F.explode("_days").alias("date"), "tic", "weight")


def trade_table(daily_weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Trades of a daily rebalanced portfolio: strategy, date, tic, gross, change.

    ``change`` is the weight bought or sold after the day's drift; ``gross`` is the day's return of
    the portfolio held since the day before. Weights and prices are read once and meet in one exchange by
    ticker, which has a row for each day and strategy at most; their moves are written and read for both columns.
    """
    days = F.broadcast(C.calendar_ordinals(prices.select("date").distinct()))  # a row for each day
    last = days.agg(F.max("ord")).scalar()
    w = daily_weights.join(days, "date").select(
        "strategy", "tic", "ord", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("double").alias("close"),
        F.lit(False).alias("_price"),
    )
    p = prices.join(days, "date").select(
        F.lit(None).cast(w.schema["strategy"].dataType).alias("strategy"), "tic", "ord", F.lit(None).cast("double").alias("weight"), "close",
        F.lit(True).alias("_price"),
    )
    none, held = F.lit(0.0), F.col("weight")

    def role(ahead: int, weight: Column, before: Column) -> Column:
        return F.struct((F.col("ord") + ahead).alias("ord"), weight.alias("weight"), before.alias("_w0"), "close")

    # a weight is what its day wants and what the next day starts with
    roles = F.when(F.col("_price"), F.array(role(0, none, none))).otherwise(F.array(role(0, held, none), role(1, none, held)))
    d = w.unionByName(p).repartition("tic").select("strategy", "tic", "_price", F.inline(roles))
    d = d.groupBy("strategy", "ord", "tic", "_price").agg(
        F.sum("weight").alias("weight"), F.sum("_w0").alias("_w0"), F.max("close").alias("close")
    )
    move = F.when(F.col("_price"), R.change(F.col("close"), Window.partitionBy("tic", "_price").orderBy("ord")))
    d = d.withColumn("r", move).withColumn("r", F.max("r").over(Window.partitionBy("tic", "ord")))
    # a name that was not held yesterday has not moved the portfolio
    moved = F.when((F.col("_w0") != 0) & F.col("tic").isNotNull(), F.col("r"))
    d = d.filter(~F.col("_price") & (F.col("ord") <= last)).withColumn("r", F.coalesce(moved, none)).drop("_price", "close")
    d = cut_lineage(d, "moves")
    gross = d.groupBy("strategy", "ord").agg(F.sum(F.col("_w0") * F.col("r")).alias("gross"))
    d = d.join(F.broadcast(gross), ["strategy", "ord"])
    # The first day buys from cash: nothing has drifted.
    drift = F.col("_w0") * (1 + F.col("r")) / (1 + F.col("gross"))
    return d.withColumn("change", F.col("weight") - drift).join(days, "ord").select(
        "strategy", "date", "tic", "gross", "change"
    )


def backtest_daily_rebalanced(
    daily_weights: DataFrame, prices: DataFrame, cost_rate: float = 0.001, capital: float = 1e6
) -> DataFrame:
    """Value path with a flat cost on the traded value: strategy, date, gross, turnover, net, value."""
    t = trade_table(daily_weights, prices).groupBy(*KEYS).agg(
        F.max("gross").alias("gross"), F.sum(F.abs("change")).alias("turnover")
    )
    net = (1 + F.col("gross")) * (1 - cost_rate * F.col("turnover")) - 1
    w = R.upto(R.by("strategy"))
    d = t.withColumn("net", net)
    return d.withColumn("value", capital * F.product(1 + F.col("net")).over(w))


def benchmark_buy_hold(series: DataFrame, capital: float = 1e6) -> DataFrame:
    """Level series scaled to the initial capital: name, date, value."""
    first = F.first("value").over(R.by("name"))
    return series.withColumn("value", capital * F.col("value") / first)


def impact_cost(alpha: float = 1.0, beta: float = 1.0, epsilon: float = 0.0005) -> Callable[[Column, Column, Column], Column]:
    """Cost of a trade as a fraction-of-value function of (value, sigma, participation).

    Half-spread plus impact that grows with volatility and participation; with alpha = beta = 0
    it is a flat rate.
    """

    def cost(value: Column, sigma: Column, share: Column) -> Column:
        return F.abs(value) * (epsilon + (alpha / 2 + beta) * sigma * share)

    return cost


def flat_cost(rate: float = 0.001) -> Callable[[Column, Column, Column], Column]:
    return lambda value, sigma, share: F.abs(value) * rate


def priced_trades(daily_weights: DataFrame, prices: DataFrame, liquidity: DataFrame, capital: float = 1e6) -> DataFrame:
    """Trade table with traded value, volatility and participation of each trade.

    ``prices(tic, date, close)``; ``liquidity(tic, date, volume, volatility)``. Sizes follow the value path before
    costs. A trade on a day without a price row uses the last known one.
    """
    every = trade_table(daily_weights, prices)
    t = every.filter(F.abs("change") > 1e-12)
    path = every.groupBy(*KEYS).agg(F.max("gross").alias("_g"))
    w = R.upto(R.by("strategy"))
    path = path.select(*KEYS, (capital * F.product(1 + F.col("_g")).over(w)).alias("_v"))
    m = prices.select("tic", "date", "close").join(liquidity, ["tic", "date"]).withColumnRenamed("date", "_pd")
    # a ticker has a row for each day and strategy at most, so its window needs no buckets
    d = J.asof_join(t, m, ["tic"], "date", "_pd", ["close", "volume", "volatility"])
    d = d.join(F.broadcast(path), list(KEYS)).withColumn("traded", F.abs("change") * F.col("_v"))
    return d.select(
        *KEYS, "tic", "traded", "volatility", (F.col("traded") / F.col("close") / F.col("volume")).alias("participation")
    )


def total_costs(trades: DataFrame, cost: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Summed cost per strategy under a cost function."""
    c = cost(F.col("traded"), F.col("volatility"), F.col("participation"))
    return trades.groupBy("strategy").agg(F.sum(c).alias("cost"))


def liquidity_sweep(
    trades: DataFrame, cost: Callable[[Column, Column, Column], Column],
    scales: Sequence[float] = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0),
) -> DataFrame:
    """Summed cost per strategy and volume scale: one aggregate with one column per scale."""
    aggs = [
        F.sum(cost(F.col("traded"), F.col("volatility"), F.col("participation") / s)).alias(f"c{i}")
        for i, s in enumerate(scales)
    ]
    wide = trades.groupBy("strategy").agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(s)).alias("scale"), F.col(f"c{i}").alias("cost")) for i, s in enumerate(scales)))
    return wide.select("strategy", F.explode(rows).alias("r")).select("strategy", "r.scale", "r.cost")


def period_portfolio_return(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Return between consecutive weight dates with as-of prices, and the compounded value."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = weights.select("date").distinct().withColumn("next_date", F.lead("date").over(w))
    d = weights.filter(F.col("weight") > 0).join(dates, "date").filter(F.col("next_date").isNotNull())
    d = J.price_on_or_before(d, prices, "date").withColumnRenamed("price", "_p0")
    d = J.price_on_or_before(d, prices, "next_date")
    move = F.when(F.col("_p0").isNotNull(), F.col("weight") * (F.col("price") / F.col("_p0") - 1))
    d = d.groupBy("date", "next_date").agg(F.coalesce(F.sum(move), F.lit(0.0)).alias("ret"))
    return d.withColumn("value", F.product(1 + F.col("ret")).over(R.upto(w)))


def long_only_quantile_portfolio(
    preds: DataFrame, returns: DataFrame, q: float = 0.75, date: str = "datadate"
) -> tuple[DataFrame, DataFrame]:
    """Daily equal-weight and per-period prediction-weighted returns of names above a quantile.

    Names chosen at a quarter end are held over the next quarter; the quarter is part of the join
    key. ``returns(tic, date, ret)``.
    """
    t = grouped_quantiles(preds, [date], "pred", {"_q": q}).drop("n")
    held = preds.join(t, date).filter(F.col("pred") >= F.col("_q")).select(
        "tic", date, "pred", "y_return", F.date_add(date, 1).alias("_quarter")
    )
    n = held.groupBy(date).agg(F.count("*").alias("_n"), F.sum("pred").alias("_s"))
    held = held.join(n, date)
    r = returns.filter(F.col("ret").isNotNull()).withColumn("_quarter", F.trunc("date", "quarter"))
    daily = held.join(r, ["tic", "_quarter"]).groupBy(date, "date").agg(
        F.sum(F.col("ret") / F.col("_n")).alias("daily_return")
    )
    period = held.groupBy(date).agg(
        F.sum(F.col("y_return") * F.col("pred") / F.col("_s")).alias("period_return")
    )
    return daily, period


def walk_forward_periods(
    rebalance: DataFrame, data_dates: DataFrame, min_rows: int = 52, window: str = "expanding", size: int | None = None
) -> DataFrame:
    """Train window, test end and validity of every rebalance date. Both inputs are short."""
    if window not in ("expanding", "rolling"):
        raise ValueError(f"unknown window type {window!r}")
    if window == "rolling" and size is None:
        raise ValueError("a rolling window needs a size")
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = C.calendar_ordinals(data_dates.select("date").distinct())
    known = dates.select(F.col("date").alias("_d"), F.col("ord"), F.lit(1).alias("_k"))
    r = rebalance.select("date").distinct().withColumns({"test_end": F.lead("date").over(w), "_k": F.lit(1)})
    r = J.asof_join(r, known, ["_k"], "date", "_d", ["ord"]).drop("_k")
    last = dates.agg(F.max("date")).scalar()
    r = r.filter(F.col("ord").isNotNull() & (F.col("date") <= last))
    first_ord = F.lit(1).cast("long") if window == "expanding" else F.greatest(F.col("ord") - (size - 1), F.lit(1).cast("long"))
    r = r.withColumn("_first", first_ord)
    starts = dates.select(F.col("ord").alias("_first"), F.col("date").alias("train_start"))
    return r.join(starts, "_first").select(
        F.col("date").alias("decision_date"), "train_start", F.col("date").alias("train_end"), "test_end",
        F.col("ord").alias("available"), (F.col("ord") >= min_rows).alias("is_valid"),
    )


def walk_forward_run(
    periods: DataFrame, data: DataFrame, func: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Run a user function once per period, and per key of ``by``, on the rows of its train window.

    ``func(key, rows)`` gets the decision date (and the key) and returns rows of ``schema``, which has the
    decision date and the columns of ``by``. A column ``error`` is added: a period whose function fails has one row of
    nulls with the error's text, a period that is not valid or has no data one that says so. Every data row is
    expanded to the periods that contain it (equi-join on the period number), then periods run in
    parallel. ``data`` should be series or group tables: a period's rows of a key are in one task.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("decision_date")
    p = periods.withColumn("_i", F.row_number().over(w).cast("long"))
    days = data.select("date", F.lit(1).alias("_k")).distinct()
    ends = p.select(F.col("decision_date").alias("_e"), "_i", F.lit(1).alias("_k"))
    begin = J.asof_join(days, ends, ["_k"], "date", "_e", ["_i"], "forward", "_lo").filter(F.col("_lo_i").isNotNull())
    # The last period that starts at or before a day: train starts never go back.
    starts = p.groupBy("train_start").agg(F.max("_i").alias("_hi")).withColumn("_k", F.lit(1))
    span = J.asof_join(begin, starts, ["_k"], "date", "train_start", ["_hi"]).filter(F.col("_hi") >= F.col("_lo_i"))
    in_periods = span.select("date", F.explode(F.sequence("_lo_i", "_hi")).alias("_i"))
    valid = p.filter("is_valid").select("_i", "decision_date")
    rows = data.join(in_periods, "date").join(valid, "_i").drop("_i")
    keys = ["decision_date", *by]
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return func(key, pdf.drop(columns="decision_date")).assign(error=None)
        except Exception as e:  # noqa: BLE001 - the period says what went wrong, the run goes on
            known = dict(zip(keys, key, strict=True))
            return pd.DataFrame([{c: known.get(c) for c in columns} | {"error": f"{type(e).__name__}: {e}"}])

    done = rows.groupBy(*keys).applyInPandas(run, f"{schema}, error string")
    out = p.join(rows.select("decision_date").distinct(), "decision_date", "left_anti")
    reason = F.when(F.col("is_valid"), "no data").otherwise("not enough data before")
    return done.unionByName(out.select("decision_date", reason.alias("error")), allowMissingColumns=True)
