"""Weights: risk budgets, rotation portfolio, fallback, stops, allocation, caps, orders, execution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions.folds import fold_rows
from stratapanel.operators import joins as J
from stratapanel.operators.regime import REGIME_LIMITS


def risk_budget(regimes: DataFrame, limits: Mapping[str, tuple[float, float]] = REGIME_LIMITS) -> DataFrame:
    """Share of capital to invest per date: full minus the floor, neutral half way between.

    A date with an active overlay (column ``is_active``, if there) uses the risk-off budget.
    """
    on, off = 1.0 - limits["risk_on"][1], 1.0 - limits["risk_off"][1]
    s = F.col("state")
    if "is_active" in regimes.columns:
        s = F.when(F.col("is_active"), "fast_risk_off").otherwise(s)
    b = F.when(s.isin("risk_off", "fast_risk_off"), off).when(s == "neutral", (on + off) / 2).otherwise(on)
    return regimes.select("date", s.alias("regime"), b.alias("risk_budget"))


def portfolio_weights(
    top: DataFrame, budget: DataFrame, exceptions: DataFrame | None = None, multiple: float = 1.5
) -> DataFrame:
    """Weights of the chosen assets per date: budget split over groups, then over their assets.

    ``top(date, sector, tic)`` is the small table of selected assets. Exceptions are weighted up
    and the total is scaled back to at most 1; what is left is cash.
    """
    groups = top.groupBy("date").agg(F.count_distinct("sector").alias("_g"))
    inside = top.groupBy("date", "sector").agg(F.count("*").alias("_a"))
    d = top.select("date", "sector", "tic").join(groups, "date").join(inside, ["date", "sector"])
    d = d.join(budget, "date")
    w = F.col("risk_budget") / F.col("_g") / F.col("_a")
    if exceptions is not None:
        e = exceptions.select("date", "tic", F.lit(multiple).alias("_m")).distinct()
        d = d.join(e, ["date", "tic"], "left")
        w = w * F.coalesce("_m", F.lit(1.0))
    d = d.withColumn("weight", w)
    total = d.groupBy("date").agg(F.sum("weight").alias("_t"))
    d = d.join(total, "date").withColumn("weight", F.when(F.col("_t") > 1, F.col("weight") / F.col("_t")).otherwise(F.col("weight")))
    cash = F.greatest(1 - F.least(F.col("_t"), F.lit(1.0)), F.lit(0.0))
    return d.select("date", "sector", "tic", "weight", cash.alias("cash"), "regime", "risk_budget")


def fallback_portfolio(budget: DataFrame, active: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Equal split of the budget over fixed symbols on dates without an active group.

    An empty list puts everything in cash.
    """
    idle = budget.join(active.select("date").distinct(), "date", "left_anti")
    if not symbols:
        return idle.select("date", F.lit(None).cast("string").alias("tic"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("cash"), "regime")
    share = F.col("risk_budget") / len(symbols)
    return idle.select(
        "date", F.explode(F.array(*(F.lit(s) for s in symbols))).alias("tic"), share.alias("weight"),
        (1 - F.col("risk_budget")).alias("cash"), "regime",
    )


def stop_loss(
    positions: DataFrame, absolute: float = -0.05, trailing: float = -0.10, cooldown_days: int = 20
) -> DataFrame:
    """Stop signals of held positions.

    ``positions(tic, entry_date, entry_price, date, close)`` has one row per held day. The peak
    includes the day itself; an absolute stop wins over a trailing one; after a signal the
    position is quiet for the cooldown (whole weeks). Windows find the breaches; only those few
    rows go through the ordered fold per position.
    """
    w = R.by("tic", "entry_date")
    peak = F.greatest(F.max("close").over(R.upto(w)), F.col("entry_price"))
    d = positions.withColumn("peak", peak).withColumns(
        {
            "from_entry": F.col("close") / F.col("entry_price") - 1,
            "from_peak": F.col("close") / F.col("peak") - 1,
        }
    )
    kind = F.when(F.col("from_entry") <= absolute, "absolute").when(F.col("from_peak") <= trailing, "trailing")
    hits = d.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    days = 7 * ((cooldown_days + 6) // 7)
    given = {"kind": "string", "entry_price": "double", "close": "double", "peak": "double", "from_entry": "double", "from_peak": "double"}
    hits = hits.withColumns({c: F.col(c).cast(t) for c, t in given.items()})

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        fire = state["until"].isNull() | (row["date"] >= state["until"])
        until = F.when(fire, F.date_add(row["date"], days)).otherwise(state["until"])
        kept = [row[c].alias(c) for c in ("date", *given)]
        return F.struct(until.alias("until")), F.struct(*kept, until.alias("cooldown_until"), fire.alias("fire"))

    zero = F.struct(F.lit(None).cast("date").alias("until"))
    out = ", ".join(["date: date", *(f"{c}: {t}" for c, t in given.items()), "cooldown_until: date", "fire: boolean"])
    return fold_rows(hits, ["tic", "entry_date"], "date", list(given), zero, step, out).filter("fire").drop("fire")


def equal_weights(selected: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """1 / n per date."""
    n = selected.groupBy(*keys).agg(F.count("*").alias("_n"))
    return selected.join(n, list(keys)).withColumn("weight", 1 / F.col("_n")).drop("_n")


def _min_variance(returns: np.ndarray) -> np.ndarray:
    """Long-only weights summing to 1 with least variance of (rows x names) returns, through the rows.

    With A the centred rows, scaled, the weights are in proportion to (1 - A'u)+ where u, one number for each row,
    is least in e|u|^2 + |(1 - A'u)+|^2: convex and quadratic between the changes of the set of held names, so
    Newton steps on that set end at the optimum. Nothing larger than rows x names is made, so the
    number of names may be large; e is a tiny ridge that picks one of equal solutions.
    """
    k = returns.shape[1]
    a = (returns - returns.mean(axis=0)) / np.sqrt(max(len(returns) - 1, 1))
    scale = float((a * a).sum()) / k
    if not np.isfinite(scale) or scale <= 0:
        return np.full(k, 1.0 / k)
    a, ridge = a / np.sqrt(scale), 1e-10
    u = np.zeros(len(a))

    def value(v: np.ndarray) -> float:
        return ridge * float(v @ v) + float((np.maximum(1 - a.T @ v, 0.0) ** 2).sum())

    for _ in range(200):
        rest = np.maximum(1 - a.T @ u, 0.0)
        held = rest > 0
        down = a @ rest - ridge * u
        own = a[:, held]
        step = np.linalg.solve(own @ own.T + ridge * np.eye(len(a)), down)
        size, now = 1.0, value(u)
        while value(u + size * step) > now - 1e-4 * size * float(down @ step) and size > 1e-12:
            size /= 2
        u = u + size * step
        same = np.array_equal(held, 1 - a.T @ u > 0)
        if same and size == 1.0 or size <= 1e-12:
            break
    x = np.maximum(1 - a.T @ u, 0.0)
    held = np.nonzero(x > 0)[0]
    if 0 < len(held) <= len(a) + 1:  # few names: what is left of 1 is rounding, so solve for them
        own = a[:, held]
        x = np.zeros(k)
        x[held] = np.maximum(np.linalg.solve(own.T @ own + ridge * np.eye(len(held)), np.ones(len(held))), 0.0)
    return x / x.sum() if x.sum() > 0 else np.full(k, 1.0 / k)


def min_variance_weights(
    selected: DataFrame, prices: DataFrame, periods: int = 8, min_rows: int = 3
) -> DataFrame:
    """Minimum-variance weights of the names selected on each date.

    ``selected(date, tic)``; ``prices(tic, datadate, price)`` of earlier and equal dates. The last
    ``periods`` price dates up to the selection count; rows and names with gaps are left out; too
    few rows give equal weights. Dates run in parallel; one date's task holds ``periods`` numbers for each of
    its own selected names, and never a table of names by names.
    """
    pairs = selected.select("date", "tic").distinct()
    # price dates are a short list: numbered once, so the last ones of a selection are found by number
    days = prices.select("datadate").distinct().withColumn(
        "_ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("datadate"))
    )
    dates = pairs.select("date").distinct().withColumn("_one", F.lit(1))
    last = J.asof_join(dates, days.withColumn("_one", F.lit(1)), ["_one"], "date", "datadate", ["_ord"])
    span = F.sequence(F.greatest(F.col("_ord") - (periods - 1), F.lit(1)), F.col("_ord"))
    keys = last.filter(F.col("_ord").isNotNull()).select("date", F.explode(span).alias("_ord")).join(days, "_ord")
    used = pairs.join(keys.select("date", "datadate"), "date").join(
        prices.select("tic", "datadate", "price"), ["tic", "datadate"]
    ).select("date", "tic", "datadate", "price")
    names = pairs.select("date", "tic", F.lit(None).cast("date").alias("datadate"), F.lit(None).cast("double").alias("price"))
    schema = "date date, tic string, weight double"

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every = sorted(pdf["tic"].unique())
        equal = pd.Series(1.0 / len(every), index=every)
        rows = pdf.dropna(subset=["datadate", "price"])
        weights = equal
        if len(rows):
            wide = rows.pivot_table(index="datadate", columns="tic", values="price", aggfunc="last").sort_index()
            r = wide.pct_change(fill_method=None).iloc[1:]
            r = r.loc[:, r.notna().all()].dropna()
            if len(r) >= min_rows and r.shape[1]:
                found = pd.Series(_min_variance(r.to_numpy()), index=r.columns)
                weights = found.reindex(every).fillna(0.0)
                weights = weights / weights.sum()
        return pd.DataFrame({"date": key[0], "tic": every, "weight": weights.reindex(every).values})

    return used.unionByName(names).groupBy("date").applyInPandas(solve, schema)


def allocate_weights(selected: DataFrame, method: str = "equal", prices: DataFrame | None = None, **kw) -> DataFrame:
    """Weights of selected rows by a method; names a method leaves out get 0."""
    if method == "min_variance" and prices is not None:
        w = min_variance_weights(selected, prices, **kw)
        return selected.join(w, ["date", "tic"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return equal_weights(selected)


def risk_caps(weights: DataFrame, per_name: float = 0.10, per_sector: float = 0.30) -> DataFrame:
    """Weights cut at a cap per name, then each sector scaled down to its cap; no scaling up.

    What the caps free stays in cash, so no cap can be broken again.
    """
    d = weights.withColumn("weight", F.least("weight", F.lit(per_name)))
    s = d.groupBy("date", "sector").agg(F.sum("weight").alias("_s"))
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(per_sector), F.col("_s")))
    return d.join(s, ["date", "sector"]).withColumn("weight", F.col("weight") * F.coalesce(scale, F.lit(1.0))).drop("_s")


def order_plan(
    targets: DataFrame, accounts: DataFrame, positions: DataFrame, prices: DataFrame,
    min_value: float = 100.0, max_value: float = 100_000.0, max_turnover: float = 0.5,
) -> DataFrame:
    """Orders that move accounts to target weights.

    ``targets(account, tic, weight)``, ``accounts(account, value)``, ``positions(account, tic,
    quantity)``, ``prices(tic, close)``. Orders below the minimum value or one share and above
    the maximum value are dropped; the rest shrink together when they turn over too much.
    """
    d = (
        targets.join(accounts, "account")
        .join(prices.select("tic", F.col("close").alias("price")), "tic")
        .join(positions, ["account", "tic"], "left")
    )
    p = F.col("price")
    move = F.col("value") * F.col("weight") - F.coalesce("quantity", F.lit(0.0)) * p
    d = d.withColumn("_move", move).withColumn("_shares", F.col("_move") / p)
    d = d.filter((F.abs("_move") >= min_value) & (F.abs("_shares") >= 1) & (F.abs("_move") <= max_value))
    t = d.groupBy("account").agg(F.sum(F.abs("_move")).alias("_turn"))
    d = d.join(t, "account")
    ratio = F.when(F.col("value") > 0, F.col("_turn") / F.col("value")).otherwise(0.0)
    scale = F.when(ratio > max_turnover, max_turnover / ratio).otherwise(1.0)
    return d.select(
        "account", "tic", F.when(F.col("_shares") > 0, "buy").otherwise("sell").alias("side"),
        (F.abs("_shares") * scale).alias("quantity"), "price",
    )


def latest_weights_normalise(weights: DataFrame) -> DataFrame:
    """Positive weights of the latest date, summed per ticker and scaled to 1."""
    last = weights.filter(F.col("date") == weights.agg(F.max("date")).scalar())
    s = last.groupBy("tic").agg(F.sum("weight").alias("weight")).filter(F.col("weight") > 0)
    return s.withColumn("weight", F.col("weight") / s.agg(F.sum("weight")).scalar())


def tsmom_signal(monthly: DataFrame, months: int = 12, band: float = 0.10, start: str | None = None) -> DataFrame:
    """Momentum sign of month-end closes: last month's close over the one ``months`` back."""
    w = Window.partitionBy("tic").orderBy("month_end")
    r = F.lag("close", 1).over(w) / F.lag("close", months).over(w) - 1
    sig = F.when(r > band, 1).when(r < -band, -1).otherwise(0)
    d = monthly.select("tic", F.col("month_end").alias("date"), r.alias("ret"), sig.alias("signal"))
    return d if start is None else d.filter(F.col("date") >= F.lit(start).cast("date"))


def event_weights(
    signals: DataFrame, events: DataFrame, ratio: float = 1.0, low: float = 0.05, high: float = 0.20, cap: int = 20
) -> DataFrame:
    """Target weights at each month's signal day and last day.

    ``signals(date, tic, signal)``, ``events(date, kind)`` with kind 'signal' or 'month_end'. A
    signal day takes the names with a signal (at most ``cap``, in the order of md5(date, ticker)), equally weighted
    within [low, high]; a signal day without any changes nothing. A month end sets the held
    names to equal weight again, keeping their sign.
    """
    day = events.filter(F.col("kind") == "signal").select("date")
    on = signals.filter(F.col("signal") != 0).join(day, "date", "left_semi")
    w = Window.partitionBy("date").orderBy(F.md5(F.concat(F.col("date").cast("string"), F.col("tic"))), "tic")
    picked = on.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")
    n = picked.groupBy("date").agg(F.count("*").alias("_n"))
    size = F.least(F.lit(high), F.greatest(F.lit(low), F.lit(ratio) / F.col("_n")))
    held = picked.join(n, "date").select("date", "tic", (F.signum(F.col("signal").cast("double")) * size).alias("weight"))
    ends = events.filter(F.col("kind") == "month_end").select("date", F.lit(1).alias("_k"))
    starts = held.select(F.col("date").alias("_from"), F.lit(1).alias("_k")).distinct()
    e = J.asof_join(ends, starts, ["_k"], "date", "_from", ["_from"]).filter(F.col("_from") < F.col("date")).select("date", "_from")
    again = held.withColumnRenamed("date", "_from").join(e, "_from").select("date", "tic", "weight")
    return held.unionByName(again)


def hold_daily(event_rows: DataFrame, days: DataFrame) -> DataFrame:
    """Weights of the latest event at or before each day."""
    ev = event_rows.select(F.col("date").alias("_from"), F.lit(1).alias("_k")).distinct()
    d = J.asof_join(days.select("date", F.lit(1).alias("_k")), ev, ["_k"], "date", "_from", ["_from"])
    d = d.filter(F.col("_from").isNotNull()).select("date", "_from")
    return d.join(event_rows.withColumnRenamed("date", "_from"), "_from").select("date", "tic", "weight")


def step_weights(signals: DataFrame, params: Sequence[Mapping]) -> DataFrame:
    """Stepwise weights of daily signals for many parameter sets at once.

    ``signals(date, ord, tic, signal, in_universe, is_rebalance)`` with ``ord`` the number of the
    day. Each set has ``name``, ``cooling``, ``allow_short``, ``max_weight``, ``gross`` (leverage cap)
    and ``max_positions``. The meaning is our own, so that every name stands for itself and a date's names
    only meet in the caps: on a rebalance day a name in the universe wants its signal at full
    weight; it wants nothing within ``cooling`` days after a rebalance day on which it stopped wanting;
    the position cap keeps the largest (ties by ticker) and the leverage cap scales a date down.
    Returns the wanted names of rebalance days with weight and action against the rebalance day before.
    """
    sets = F.array(*(
        F.struct(
            F.lit(p["name"]).alias("params"), F.lit(int(p.get("cooling", 0))).alias("cooling"),
            F.lit(bool(p.get("allow_short", True))).alias("allow_short"), F.lit(float(p.get("max_weight", 0.2))).alias("max_weight"),
            F.lit(float(p.get("gross", 1.0))).alias("gross"), F.lit(int(p.get("max_positions", 20))).alias("cap"),
        )
        for p in params
    ))
    name = Window.partitionBy("params", "tic").orderBy("ord")
    d = signals.filter("is_rebalance").withColumn("_s", F.explode(sets)).select("_s.*", *signals.columns)
    sign = F.signum(F.col("signal").cast("double"))
    sign = F.when(F.col("in_universe") & (F.col("allow_short") | (sign > 0)), sign).otherwise(0.0)
    d = d.withColumn("_sign", sign).withColumn("_before", F.coalesce(F.lag("_sign").over(name), F.lit(0.0)))
    stopped = F.when((F.col("_sign") == 0) & (F.col("_before") != 0), F.col("ord"))
    d = d.withColumn("_stopped", F.max(stopped).over(name.rowsBetween(Window.unboundedPreceding, -1)))
    quiet = F.coalesce(F.col("ord") < F.col("_stopped") + F.col("cooling"), F.lit(False))
    d = d.withColumn("_want", F.when(quiet, F.lit(0.0)).otherwise(F.col("_sign") * F.col("max_weight")))
    d = d.withColumn("_held", F.coalesce(F.lag("_want").over(name), F.lit(0.0)))
    day = Window.partitionBy("params", "date").orderBy(F.desc(F.abs("_want")), "tic")
    top = d.filter("_want != 0").withColumn("_rn", F.row_number().over(day)).filter(F.col("_rn") <= F.col("cap"))
    gross = top.groupBy("params", "date").agg(F.sum(F.abs("_want")).alias("_gross"))
    top = top.join(gross, ["params", "date"])
    scale = F.least(F.lit(1.0), F.col("gross") / F.col("_gross"))
    opened = F.when(F.col("_want") > 0, "OPEN_LONG").otherwise("OPEN_SHORT")
    action = F.when(F.col("_held") == 0, opened).when(F.col("_held") != F.col("_want"), "FLIP").otherwise("HOLD")
    return top.select("params", "date", "tic", (F.col("_want") * scale).alias("weight"), action.alias("action"))
