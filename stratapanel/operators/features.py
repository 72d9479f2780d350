"""Time-series features per ticker.

Every window is over one ticker in date order. A ticker has at most one row per day, so a window
partition is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions.folds import fold_rows
from stratapanel.operators import cleaning as K
from stratapanel.sources.scratch import cut_lineage

MAD_FLOOR = 1e-6
MAD_TO_STD = 1.4826


def simple_return(
    value: Column, n: int = 1, key: str = "tic", order: str = "date", ffill: bool = False
) -> Column:
    """Relative change against n rows before; ``ffill`` carries the last known value over gaps."""
    w = R.by(key, order=order)
    if ffill:
        known = F.last(value, ignorenulls=True)
        base = known.over(w.rowsBetween(Window.unboundedPreceding, -n))
        return F.try_divide(known.over(R.upto(w)), base) - 1
    return R.change(value, w, n)


def sma(df: DataFrame, value: str, periods: Sequence[int] = (5, 10, 20, 50, 200)) -> DataFrame:
    """Rolling means, null until the window is full."""
    w = R.by("tic")
    return df.withColumns({f"sma_{n}": R.rolling_mean(F.col(value), w, n) for n in periods})


def rolling_volatility(df: DataFrame, value: str, periods: Sequence[int] = (20, 60)) -> DataFrame:
    """Rolling sample deviations, null until the window is full."""
    w = R.by("tic")
    return df.withColumns({f"vol_{n}": R.rolling_std(F.col(value), w, n) for n in periods})


def rsi(df: DataFrame, value: str, n: int = 14, name: str = "rsi_14") -> DataFrame:
    """Simple-average RSI from the n-th row on; the first row counts as no change.

    Only gains give 100, no change at all gives null.
    """
    w = R.by("tic")
    frame = R.last_rows(w, n)
    step = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    d = df.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))})
    up, down = F.avg("_up").over(frame), F.avg("_down").over(frame)
    ratio = F.when((up > 0) | (down > 0), 100 * up / (up + down))
    return d.withColumn(name, F.when(F.count("*").over(frame) == n, ratio)).drop("_up", "_down")


def macd(df: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two bias-adjusted exponential means and its own exponential mean.

    One fold over a ticker's days carries, for each mean, the weighted sum of the values and the sum of the
    weights; a day without a value keeps the means.
    """
    def mean(state: Column, name: str, span: int, x: Column) -> tuple[Column, Column]:
        keep = F.lit((span - 1) / (span + 1))
        return (
            state[f"{name}_sum"] * keep + F.coalesce(x, F.lit(0.0)), state[f"{name}_weight"] * keep + x.isNotNull().cast("double")
        )

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        new = {"fast": mean(state, "fast", fast, row["x"]), "slow": mean(state, "slow", slow, row["x"])}
        line = F.try_divide(*new["fast"]) - F.try_divide(*new["slow"])
        new["signal"] = mean(state, "signal", signal, line)
        fields = [f.alias(f"{n}_{part}") for n, pair in new.items() for f, part in zip(pair, ("sum", "weight"), strict=True)]
        return F.struct(*fields), F.struct(
            row["date"].alias("date"), line.alias("macd"), F.try_divide(*new["signal"]).alias("macd_signal")
        )

    zero = F.struct(*(F.lit(0.0).alias(f"{n}_{part}") for n in ("fast", "slow", "signal") for part in ("sum", "weight")))
    small = df.select("tic", "date", F.col(value).cast("double").alias("x"))
    return fold_rows(small, ["tic"], "date", ["x"], zero, step, "date: date, macd: double, macd_signal: double")


def profit_margin(df: DataFrame, income: str = "net_income", revenue: str = "revenue") -> DataFrame:
    """Margin when both columns are there; the table unchanged otherwise."""
    if income not in df.columns or revenue not in df.columns:
        return df
    return df.withColumn("profit_margin", F.try_divide(F.col(income), F.col(revenue)))


def momentum_features(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Quarterly returns and factor changes, imputed and clipped, plus return acceleration.

    ``changes`` maps a factor to the name of its quarter-to-quarter difference.
    """
    w = Window.partitionBy("tic").orderBy("datadate")
    p = F.col("trade_price")
    d = df.withColumns(
        {
            "ret_1q": R.change(p, w, 1),
            "ret_4q": R.change(p, w, 4),
            **{dst: F.col(src) - F.lag(src).over(w) for src, dst in changes.items()},
        }
    )
    cols = ["ret_1q", "ret_4q", *changes.values()]
    # The quantile passes below read the features several times; write them once.
    d = cut_lineage(d, "momentum")
    d = K.winsorize_quantile(K.global_median_impute(d, cols), cols)
    d = d.withColumn("ret_accel", F.coalesce(F.col("ret_1q") - F.col("ret_4q") / 4, F.lit(0.0)))
    return K.winsorize_quantile(d, ["ret_accel"])


def logret_rolling_vol(df: DataFrame, price: str, n: int = 20) -> DataFrame:
    """Log return (first row 0) and its rolling deviation, defined from the first row on."""
    w = R.by("tic")
    ret = F.coalesce(F.ln(F.try_divide(F.col(price), F.lag(price).over(w))), F.lit(0.0))
    vol = F.stddev_samp("log_ret").over(R.last_rows(w, max(n, 2)))
    return df.withColumn("log_ret", ret).withColumn("volatility", F.coalesce(vol, F.lit(0.0)))


def volume_panel(df: DataFrame, volume: str, seq: str) -> DataFrame:
    """Last volume per (tic, date); zero or unknown takes the last positive one, else 1."""
    last = df.groupBy("tic", "date").agg(F.max_by(volume, seq).alias("volume"))
    known = F.last(F.nullif(F.col("volume"), F.lit(0.0)), ignorenulls=True)
    return last.withColumn("volume", F.coalesce(known.over(R.upto(R.by("tic"))), F.lit(1.0)))


def future_return_label(price: Column, n: int = 63, key: str = "tic", order: str = "date") -> Column:
    """Return over the next n rows."""
    return F.try_divide(F.lead(price, n).over(R.by(key, order=order)), price) - 1


def forward_log_return(price: Column, key: str = "tic", order: str = "datadate") -> Column:
    """ln(next / this), both positive, rounded to 6 digits."""
    nxt = F.lead(price).over(R.by(key, order=order))
    return F.round(F.when((price > 0) & (nxt > 0), F.ln(nxt / price)), 6)


def label_check(df: DataFrame, price: str, label: str) -> DataFrame:
    """Rows, labels that differ from a recomputation by more than 1e-4, and zero labels."""
    again = forward_log_return(F.col(price))
    d = df.withColumn("_again", again)
    return d.agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(F.col(label) - F.col("_again")) > 1e-4).alias("wrong"),
        F.count_if(F.col(label) == 0).alias("zero"),
        F.count_if(F.col(label).isNull()).alias("unlabelled"),
    )


def last_label_fill(labels: DataFrame, prices: DataFrame) -> DataFrame:
    """Label of each ticker's last quarter from daily prices around the next quarter end.

    ``labels``: tic, datadate, price, y_return. The price nearest the next quarter end within
    [-7, +3] days is used, else the last one not later than 3 days after it.
    """
    last = labels.groupBy("tic").agg(
        F.max_by(F.struct("datadate", "price", "y_return"), "datadate").alias("r")
    ).select("tic", "r.*")
    todo = last.filter(F.col("y_return").isNull() & (F.col("price") > 0)).select(
        "tic", "datadate", F.col("price").alias("_p"),
        F.last_day(F.add_months(F.trunc(F.date_add("datadate", 1), "quarter"), 2)).alias("_target"),
    )
    gap = F.datediff("date", "_target")
    near = prices.join(todo, "tic").filter(gap <= 3).groupBy("tic", "datadate", "_p").agg(
        F.min_by("close", F.when(gap >= -7, F.struct(F.abs(gap).alias("d"), F.col("date")))).alias("_near"),
        F.max_by("close", "date").alias("_last"),
    )
    nxt = F.coalesce("_near", "_last")
    fill = near.select("tic", "datadate", F.when(nxt > 0, F.ln(nxt / F.col("_p"))).alias("_fill"))
    return labels.join(fill, ["tic", "datadate"], "left").withColumn(
        "y_return", F.coalesce("y_return", "_fill")
    ).drop("_fill")


def mad_score(xs: Column, value: Column, center: str = "median") -> Column:
    """(value - centre) / MAD of an array of doubles; below the MAD floor 0 or plus or minus 10."""
    centers = {
        "median": R.array_median,
        "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a),
    }
    if center not in centers:
        raise ValueError(f"unknown centre {center!r}")

    def scaled(off: Column, m: Column) -> Column:
        flat = F.when(F.abs(off) < MAD_FLOOR, 0.0).otherwise(10.0 * F.signum(off))
        return F.when(m < MAD_FLOOR, flat).otherwise(F.try_divide(off, m))

    return R.let(
        centers[center](xs), lambda c: R.let(R.array_mad(xs, c), lambda m: scaled(value - c, m))
    )


def robust_zscore(
    value: Column,
    n: int,
    center: str = "median",
    key: str = "tic",
    order: str = "date",
    min_rows: int | None = None,
) -> Column:
    """Robust score of the last of n values, null until ``min_rows`` (default n) values are there.

    The frame is an array of at most n doubles; every step on it is evaluated once per row.
    """
    xs = F.collect_list(value).over(R.last_rows(R.by(key, order=order), n))
    need = n if min_rows is None else min_rows
    return R.let(
        xs, lambda a: F.when((F.size(a) >= need) & value.isNotNull(), mad_score(a, value, center))
    )


def with_rolling_mad(df: DataFrame, value: str, n: int, name: str = "mad") -> DataFrame:
    """Rolling median of the distance of each row to its own rolling median."""
    w = R.by("tic")
    d = df.withColumn("_med", R.rolling_median(F.col(value), w, n))
    d = d.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return d.withColumn(name, R.rolling_median(F.col("_dev"), w, n)).drop("_med", "_dev")


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Whole-series median absolute deviation per key, and the same scaled to a deviation.

    Both medians are exact and spread over tasks, so a key may hold any number of rows.
    """
    from stratapanel.functions.order_stats import grouped_quantiles

    keys = list(keys)
    med = grouped_quantiles(df, keys, value, {"_med": 0.5}).drop("n")
    dev = df.select(*keys, F.col(value).alias("_x")).join(med, keys).select(
        *keys, F.abs(F.col("_x") - F.col("_med")).alias("_dev")
    )
    out = grouped_quantiles(dev, keys, "_dev", {"mad": 0.5}).drop("n")
    return out.withColumn("mad_std", F.col("mad") * MAD_TO_STD)


def information_ratio(
    excess: Column, n: int, robust: bool = True, scale: float = 1.0, key: str = "tic", order: str = "date"
) -> Column:
    """Mean excess over the last n rows by their MAD (by the sample deviation where it is 0)."""
    frame = R.last_rows(R.by(key, order=order), n)
    std = F.nullif(F.stddev_samp(excess).over(frame), F.lit(0.0))
    spread = std
    if robust:
        xs = F.collect_list(excess).over(frame)
        mad_of = lambda a: R.let(R.array_median(a), lambda c: R.array_mad(a, c))
        spread = F.coalesce(F.nullif(R.let(xs, mad_of), F.lit(0.0)), std)
    ir = F.try_divide(F.avg(excess).over(frame), spread)
    if scale != 1.0:
        ir = ir * F.sqrt(F.lit(scale))
    return F.when(F.count(excess).over(frame) == n, ir)


def outliers_and_mad_winsorize(
    df: DataFrame, value: str, n: int, threshold: float = 3.0, n_mad: float = 3.0
) -> DataFrame:
    """Outlier flag from the robust z-score, and the value pulled back to n MADs of the median.

    The first n-1 rows keep their value; the next n-1 stay null because the rolling MAD needs a
    full window of rows that themselves had a full window.
    """
    w = R.by("tic")
    x = F.col(value)
    d = with_rolling_mad(df, value, n, "_mad").withColumns(
        {
            "_z": robust_zscore(x, n),
            "_med": R.rolling_median(x, w, n),
            "_row": F.row_number().over(w),
        }
    )
    z = F.least(F.greatest(F.col("_z"), F.lit(-n_mad)), F.lit(n_mad))
    pulled = F.when(F.col("_z").isNotNull(), F.col("_med") + z * F.col("_mad"))
    return d.withColumns(
        {
            "outlier": F.coalesce(F.abs("_z") > threshold, F.lit(False)),
            "winsorized": F.when(F.col("_row") < n, x).otherwise(pulled),
        }
    ).drop("_mad", "_z", "_med", "_row")


def rolling_sharpe(
    df: DataFrame, value: str, name: str, n: int = 252, key: str = "tic", order: str = "date"
) -> DataFrame:
    """Add the annualised mean over deviation of the last n returns; no deviation gives 0, fewer than n null."""
    d = R.with_last_moments(df, value, "_moments", n, key, order)
    m = F.col("_moments")
    std = F.when(m["low"] == m["high"], F.when(F.abs(m["low"]) < float("inf"), 0.0).otherwise(float("nan")))
    std = std.otherwise(F.sqrt(m["squares"] / (m["n"] - 1)))
    ratio = F.when(std > 0, m["total"] / m["n"] / std * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return d.withColumn(name, F.when(m["n"] == n, ratio)).drop("_moments")


def drawdown(value: Column, key: str = "tic", order: str = "date") -> Column:
    """Distance to the running maximum."""
    return value / F.max(value).over(R.upto(R.by(key, order=order))) - 1


#: Series that a pairwise matrix takes at most: 500 give 125,250 pairs for each date.
MOST_SERIES = 500


def _chosen(series: DataFrame, names: Sequence[str]) -> DataFrame:
    wanted = sorted(set(names))
    if not 0 < len(wanted) <= MOST_SERIES:
        raise ValueError(f"a pairwise matrix takes 1 to {MOST_SERIES} series, {len(wanted)} named")
    return series.filter(F.col("name").isin(wanted))


def rolling_covariance(series: DataFrame, names: Sequence[str], n: int = 252) -> DataFrame:
    """Covariance of every pair of the named series over the last n + 1 levels (n returns) per date.

    ``series``: name, date, close. The result is quadratic in the number of series by definition,
    so they are named, at most ``MOST_SERIES``; all dates come from one plan.
    """
    w = R.by("name")
    r = _chosen(series, names).select("name", "date", R.change(F.col("close"), w).alias("r"))
    a = r.select(F.col("name").alias("name_i"), "date", F.col("r").alias("_a"))
    b = r.select(F.col("name").alias("name_j"), "date", F.col("r").alias("_b"))
    pairs = a.join(b, "date").filter(F.col("name_i") <= F.col("name_j"))
    pw = R.by("name_i", "name_j")
    frame = R.last_rows(pw, n)
    full = F.count(F.col("_a") * F.col("_b")).over(frame) == n
    cov = F.covar_samp("_a", "_b").over(frame)
    out = pairs.withColumns({"cov": F.when(full, cov)})
    return out.filter(F.col("cov").isNotNull()).select("date", "name_i", "name_j", "cov")


def correlation_matrix(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (name_i <= name_j) of the named return series on their common dates.

    Series are named as for the covariance.
    """
    w = R.by("name")
    r = _chosen(series, names).select("name", "date", R.change(F.col("close"), w).alias("r")).dropna()
    a = r.select(F.col("name").alias("name_i"), "date", F.col("r").alias("_a"))
    b = r.select(F.col("name").alias("name_j"), "date", F.col("r").alias("_b"))
    pairs = a.join(b, "date").filter(F.col("name_i") <= F.col("name_j"))
    return pairs.groupBy("name_i", "name_j").agg(F.corr("_a", "_b").alias("corr"))


def frozen_price_pairs(df: DataFrame, value: str, order: str = "date") -> DataFrame:
    """How often a positive price equals the one before, per ticker."""
    prev = F.lag(value).over(R.by("tic", order=order))
    same = F.coalesce((F.col(value) == prev) & (F.col(value) > 0), F.lit(False))
    return df.withColumn("_same", same).groupBy("tic").agg(F.count_if("_same").alias("frozen"))
