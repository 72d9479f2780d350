"""Aggregations: weekly and monthly bars, group returns, strength, performance tables.

Performance functions take ``series(name, date, value)`` levels and give one row per name. A
series has one row per day at most, so its windows are bounded by the calendar, and every name
is measured in the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.operators import features as W
from stratapanel.operators import joins as J

YEAR = 252.0


def week_map(days: DataFrame, week_ends: DataFrame) -> DataFrame:
    """The week-end each day counts for: the next one, unless the day directly follows the week-end
    before (that day is left out); the first week reaches back 7 days. Both lists are short."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    ends = week_ends.select(
        F.col("date").alias("week_end"), F.lag("date").over(w).alias("_prev"), F.lit(1).alias("_one")
    )
    d = days.select("date").distinct().withColumn("_one", F.lit(1))
    m = J.asof_join(d, ends, ["_one"], "date", "week_end", ["week_end", "_prev"], "forward")
    low = F.coalesce(F.date_add("_prev", 1), F.date_sub("week_end", 7))
    return m.filter(F.col("date") > low).select("date", "week_end")


def weekly_ohlcv(daily: DataFrame, week_ends: DataFrame, method: str = "last_available") -> DataFrame:
    """Weekly bars per ticker dated at the week-end; a week without rows has no bar."""
    if method == "strict":
        return daily.join(week_ends, "date", "left_semi")
    if method != "last_available":
        raise ValueError(f"unknown weekly method {method!r}")
    d = daily.join(week_map(daily, week_ends), "date")
    return d.groupBy("tic", F.col("week_end").alias("_w")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("_w", "date")


def month_last_price(df: DataFrame) -> DataFrame:
    """Last known close of each calendar month, dated at the month end."""
    return (
        df.filter(F.col("close").isNotNull())
        .groupBy("tic", F.last_day("date").alias("month_end"))
        .agg(F.max_by("close", "date").alias("close"))
    )


def group_equal_weight_return(returns: DataFrame, group: str, last: int | None = None) -> DataFrame:
    """Mean member return per group and date, nulls left out.

    ``last`` keeps the newest prices of each ticker only; the oldest kept one has no return.
    """
    r = returns
    if last is not None:
        w = Window.partitionBy("tic").orderBy(F.desc("date"))
        r = r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last)
        r = r.withColumn("ret", F.when(F.col("_rn") < last, F.col("ret")))
    return r.groupBy(group, "date").agg(F.avg("ret").alias("ret"))


def compounded_return(ret: Column, n: int, key: str = "tic", order: str = "date") -> Column:
    """Product of 1 + r over the last n rows minus 1, nulls left out."""
    return F.product(1 + ret).over(R.last_rows(R.by(key, order=order), n)) - 1


def group_strength(groups: DataFrame, bench: DataFrame, weeks: int = 12, robust: bool = True) -> DataFrame:
    """Strength of each group against the benchmark at every week.

    ``groups(sector, date, ret)`` and ``bench(date, ret)`` are weekly. A window of ``weeks`` prices
    has one return less. Fewer than 80 % usable weeks make a row invalid.
    """
    d = groups.join(bench.select("date", F.col("ret").alias("_b")), "date").withColumn(
        "_x", F.col("ret") - F.col("_b")
    )
    w = R.by("sector")
    frame = R.last_rows(w, weeks - 1)
    used = F.col("_x").isNotNull()
    n = F.count("_x").over(frame)
    xs = F.collect_list("_x").over(frame)
    std = F.nullif(F.stddev_samp("_x").over(frame), F.lit(0.0))
    mad = R.let(xs, lambda a: R.let(R.array_median(a), lambda c: R.array_mad(a, c)))
    spread = F.coalesce(F.nullif(mad, F.lit(0.0)), std) if robust else std

    def grown(r: str) -> Column:
        return F.product(F.when(used, 1 + F.col(r))).over(frame) - 1

    valid = (n >= 0.8 * weeks) & (F.row_number().over(w) >= weeks)
    d = d.withColumns(
        {
            "periods": n,
            "is_valid": valid,
            "group_return": grown("ret"),
            "benchmark_return": grown("_b"),
            "information_ratio": F.coalesce(F.try_divide(F.avg("_x").over(frame), spread), F.lit(0.0)),
        }
    )
    ok = F.col("is_valid")
    return d.select(
        "sector",
        "date",
        "periods",
        "is_valid",
        F.when(ok, F.col("group_return") - F.col("benchmark_return")).otherwise(0.0).alias("excess_return"),
        F.when(ok, F.col("information_ratio")).otherwise(0.0).alias("information_ratio"),
    )


def series_returns(series: DataFrame) -> DataFrame:
    """Series with return and drawdown of each row against its own past."""
    w = R.by("name")
    v = F.col("value")
    return series.withColumns(
        {
            "ret": v / F.lag(v).over(w) - 1,
            "drawdown": v / F.max(v).over(R.upto(w)) - 1,
        }
    )


def unbiased_skewness(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def _span(series: DataFrame) -> list[Column]:
    return [
        F.min_by("value", "date").alias("_first"),
        F.max_by("value", "date").alias("_last"),
        F.count("ret").alias("_n"),
        F.min("drawdown").alias("max_drawdown"),
    ]


def monthly_metrics(series: DataFrame) -> DataFrame:
    """Mean, deviation, Sharpe and Sortino of compounded calendar-month returns."""
    m = (
        series_returns(series)
        .filter(F.col("ret").isNotNull())
        .groupBy("name", F.last_day("date").alias("month"))
        .agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    )
    down = F.when(F.col("r") < 0, F.col("r"))
    d = m.groupBy("name").agg(
        F.avg("r").alias("monthly_return"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("monthly_volatility"),
        F.coalesce(F.stddev_samp(down), F.lit(0.0)).alias("_down"),
    )
    mean = F.col("monthly_return")
    return d.withColumns(
        {
            "monthly_sharpe": _ratio(mean, F.col("monthly_volatility")),
            "monthly_sortino": _ratio(mean, F.col("_down")),
        }
    ).drop("_down")


def perf_metrics_backtest(series: DataFrame) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, skewness and kurtosis of daily levels."""
    down = F.when(F.col("ret") < 0, F.col("ret"))
    d = series_returns(series).groupBy("name").agg(
        *_span(series),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("_std"),
        F.coalesce(F.stddev_samp(down), F.lit(0.0)).alias("_down"),
        F.coalesce(unbiased_skewness("ret"), F.lit(0.0)).alias("skewness"),
        F.coalesce(unbiased_kurtosis("ret"), F.lit(0.0)).alias("kurtosis"),
    )
    total = F.col("_last") / F.col("_first") - 1
    annual = F.pow(1 + total, YEAR / F.greatest("_n", F.lit(1))) - 1
    vol = F.col("_std") * F.sqrt(F.lit(YEAR))
    return d.select(
        "name",
        total.alias("total_return"),
        annual.alias("annual_return"),
        vol.alias("annual_volatility"),
        _ratio(annual, vol).alias("sharpe_ratio"),
        _ratio(annual, F.col("_down") * F.sqrt(F.lit(YEAR))).alias("sortino_ratio"),
        "max_drawdown",
        "skewness",
        "kurtosis",
    )


def perf_metrics_account(series: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Account table in percent with population deviation; fewer than two points give zeros."""
    d = series_returns(series).groupBy("name").agg(
        *_span(series), F.stddev_pop("ret").alias("_std"), F.product(1 + F.col("ret")).alias("_grown")
    )
    annual = (F.pow("_grown", YEAR / F.col("_n")) - 1) * 100
    vol = F.col("_std") * F.sqrt(F.lit(YEAR)) * 100
    sharpe = F.when(vol > 1e-12, (annual / 100 - risk_free) / (vol / 100)).otherwise(0.0)
    out = {
        "total_return": (F.col("_last") / F.col("_first") - 1) * 100,
        "annual_return": annual,
        "annual_volatility": vol,
        "sharpe_ratio": sharpe,
        "max_drawdown": F.col("max_drawdown") * 100,
    }
    enough = F.col("_n") > 0
    return d.select("name", *(F.when(enough, c).otherwise(0.0).alias(k) for k, c in out.items()))


def weight_changes(weights: DataFrame) -> DataFrame:
    """Change of every weight between consecutive dates of the table: date, tic, change.

    A name missing on a date has weight 0 there. Only real changes are produced; the first date
    has none.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = weights.select("date").distinct()
    dates = dates.withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("date").over(w)})
    t = R.by("tic")
    d = weights.join(dates, "date").withColumns(
        {
            "_was": F.when(F.lag("date").over(t) == F.col("_prev"), F.lag("weight").over(t)),
            "_stays": F.lead("date").over(t).eqNullSafe(F.col("_next")),
        }
    )
    moves = F.array(
        F.when(
            F.col("_prev").isNotNull(),
            F.struct(F.col("date").alias("date"), (F.col("weight") - F.coalesce("_was", F.lit(0.0))).alias("change")),
        ),
        F.when(
            ~F.col("_stays") & F.col("_next").isNotNull(),
            F.struct(F.col("_next").alias("date"), (-F.col("weight")).alias("change")),
        ),
    )
    return d.select("tic", F.explode(F.array_compact(moves)).alias("m")).select("m.date", "tic", "m.change")


def perf_metrics_weights(returns: DataFrame, weights: DataFrame, rf_annual: float = 0.0) -> DataFrame:
    """One row: equity statistics of daily returns plus weight sums and turnover.

    ``returns(date, daily_return)``, ``weights(date, tic, weight)``.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    eq = returns.dropna().withColumn("_eq", F.product(1 + F.col("daily_return")).over(R.upto(w)))
    eq = eq.withColumn("_dd", F.col("_eq") / F.max("_eq").over(R.upto(w)) - 1)
    rf = (1.0 + rf_annual) ** (1.0 / YEAR) - 1.0
    a = eq.agg(
        F.count("*").alias("n_days"),
        F.max_by("_eq", "date").alias("_last"),
        F.stddev_samp("daily_return").alias("_std"),
        F.avg(F.col("daily_return") - rf).alias("_mean"),
        F.min("_dd").alias("max_drawdown"),
    )
    vol = F.col("_std") * F.sqrt(F.lit(YEAR))
    a = a.select(
        "n_days",
        (F.col("_last") - 1).alias("total_return"),
        (F.pow("_last", YEAR / F.col("n_days")) - 1).alias("annual_return"),
        vol.alias("annual_vol"),
        F.when(vol > 0, F.col("_mean") * YEAR / vol).alias("sharpe"),
        "max_drawdown",
    )
    s = weights.groupBy("date").agg(F.sum("weight").alias("s")).agg(
        F.min("s").alias("weights_sum_min"), F.avg("s").alias("weights_sum_mean"), F.max("s").alias("weights_sum_max")
    )
    per_day = weight_changes(weights).groupBy("date").agg((F.sum(F.abs("change")) / 2).alias("t"))
    later = weights.agg(F.count_distinct("date") - 1).scalar()
    t = per_day.agg(F.sum("t").alias("total_turnover")).withColumn(
        "avg_daily_turnover", F.try_divide(F.col("total_turnover"), later)
    )
    one = F.lit(1).alias("_k")
    return a.select("*", one).join(s.select("*", one), "_k").join(t.select("*", one), "_k").drop("_k")


def perf_metrics_weekly(series: DataFrame) -> DataFrame:
    """Growth by calendar days, weekly volatility, Sharpe, drawdown, Calmar and win rate."""
    d = series_returns(series).groupBy("name").agg(
        *_span(series),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.stddev_samp("ret").alias("_std"),
        F.count_if(F.col("ret") > 0).alias("_wins"),
    )
    growth = F.col("_last") / F.col("_first")
    annual = F.pow(growth, 365.25 / F.col("_days")) - 1
    vol = F.col("_std") * F.sqrt(F.lit(52.0))
    dd = F.col("max_drawdown")
    return d.select(
        "name",
        growth.alias("cumulative"),
        annual.alias("annual_return"),
        vol.alias("annual_volatility"),
        _ratio(annual, vol).alias("sharpe_ratio"),
        "max_drawdown",
        F.when(dd != 0, annual / F.abs(dd)).otherwise(0.0).alias("calmar_ratio"),
        (F.col("_wins") / F.col("_n")).alias("win_rate"),
    )


def var_cvar(series: DataFrame, level: float = 0.05) -> DataFrame:
    """Return quantile of each series and the mean of the returns at or below it."""
    r = series_returns(series).filter(F.col("ret").isNotNull()).select("name", "ret")
    v = r.groupBy("name").agg(F.percentile("ret", F.lit(level)).alias("var"))
    tail = F.when(F.col("ret") <= F.col("var"), F.col("ret"))
    return r.join(v, "name").groupBy("name", "var").agg(F.avg(tail).alias("cvar"))


def backtest_summary(decisions: DataFrame) -> DataFrame:
    """Decision count, share, mean invested weight and mean holdings per regime and overall.

    ``decisions(date, regime, invested, num_assets)``.
    """
    d = decisions.rollup("regime").agg(
        F.count("*").alias("decisions"),
        F.avg("invested").alias("avg_invested"),
        F.avg("num_assets").alias("avg_assets"),
    )
    total = decisions.agg(F.count("*")).scalar()
    return d.withColumn("share", F.col("decisions") / total).withColumn(
        "regime", F.coalesce("regime", F.lit("all"))
    )


# Features counted as momentum.
MOMENTUM_FEATURES = ("ret_1q", "ret_4q", "ret_accel", "eps_chg", "roe_chg", "gm_chg", "om_chg")


def feature_class(name: Column) -> Column:
    return (
        F.when(name.isin(*MOMENTUM_FEATURES), "momentum")
        .when(F.startswith(name, F.lit("sector_")), "sector")
        .otherwise("fundamental")
    )


def model_leaderboard(models: DataFrame, features: DataFrame, top: int = 15) -> DataFrame:
    """Mean validation error per model with the best marked, and the top features of best models.

    One table: kind 'model' or 'feature', name, value, is_best, class.
    """
    m = models.groupBy("model").agg(F.avg("val_mse").alias("value"))
    best = m.agg(F.min_by("model", F.struct("value", "model"))).scalar()
    m = m.select(
        F.lit("model").alias("kind"), F.col("model").alias("name"), "value",
        (F.col("model") == best).alias("is_best"), F.lit(None).cast("string").alias("class"),
    )
    f = features.filter("is_best").groupBy("feature").agg(F.avg("importance").alias("value"))
    f = f.orderBy(F.desc("value"), "feature").limit(top).select(
        F.lit("feature").alias("kind"), F.col("feature").alias("name"), "value",
        F.lit(True).alias("is_best"), feature_class(F.col("feature")).alias("class"),
    )
    return m.unionByName(f)


def sector_daily_return(trades: DataFrame, price: str, start: str) -> DataFrame:
    """Mean price per (date, tic) and its change, from the first trade date on."""
    m = trades.groupBy("date", "tic").agg(F.avg(price).alias("price"))
    m = m.withColumn("ret", W.simple_return(F.col("price")))
    return m.filter(F.col("date") >= F.lit(start).cast("date"))
