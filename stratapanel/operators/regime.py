"""Market regime: weekly risk score, daily shocks, and the fast overlay that remembers a trigger.

Index tables have one row per day or week for the whole market, so windows over them are short
whatever the size of the price panel. Parameter sets are a key: many settings run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions.folds import fold_rows
from stratapanel.operators import features as W
from stratapanel.operators import joins as J

# Group cap and cash floor of each regime state.
REGIME_LIMITS = {"risk_on": (1.0, 0.0), "neutral": (0.7, 0.1), "risk_off": (0.5, 0.3)}
FAST_CAP, FAST_FLOOR = 0.3, 0.5



def slow_regime(
    index: DataFrame, ma_weeks: int = 26, dd_weeks: int = 13, dd_limit: float = 0.10, z_weeks: int = 156, z_limit: float = 3.0
) -> DataFrame:
    """Risk score 0 to 3 of every week of ``index(date, spx, vix)``."""
    p = F.col("spx")
    d = index.withColumn("_k", F.lit(1))
    ma = R.rolling_mean(p, R.whole(), ma_weeks)
    peak = R.full(p, F.max(p), R.whole(), dd_weeks)
    z = F.coalesce(W.robust_zscore(F.col("vix"), z_weeks, key="_k", min_rows=52), F.lit(0.0))
    d = d.withColumns({"ma": ma, "drawdown": F.coalesce((p - peak) / peak, F.lit(0.0)), "vix_z": z})

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    d = d.withColumns(
        {
            "trend_down": flag(p < F.col("ma")),
            "drawdown_stress": flag(F.col("drawdown") <= -dd_limit),
            "vol_stress": flag(F.col("vix_z") >= z_limit),
        }
    )
    score = sum((F.col(c).cast("long") for c in ("trend_down", "drawdown_stress", "vol_stress")), F.lit(0))
    return d.withColumn("risk_score", score.cast("long")).drop("_k")


def regime_mapping(scored: DataFrame, persistence: int = 2) -> DataFrame:
    """State, group cap and cash floor of each score, and whether the state has lasted."""
    s = F.col("risk_score")
    state = F.when(s == 0, "risk_on").when(s == 1, "neutral").otherwise("risk_off")
    d = scored.withColumn("state", state)
    cap, floor = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (c, f) in REGIME_LIMITS.items():
        cap = F.when(F.col("state") == name, F.lit(c)).otherwise(cap)
        floor = F.when(F.col("state") == name, F.lit(f)).otherwise(floor)
    lasted = F.lit(True)
    for k in range(1, persistence):
        lasted = lasted & F.coalesce(F.lag("state", k).over(R.whole()) == F.col("state"), F.lit(False))
    return d.withColumns({"group_cap": cap, "cash_floor": floor, "is_persistent": lasted})


def price_vol_shock(
    daily: DataFrame, days: int = 3, limit: float = -0.03, z_limit: float = 3.0, dz_limit: float = 3.5, rows: int = 756
) -> DataFrame:
    """Price and volatility shock flags of every day of ``daily(date, spx, qqq, vix)``.

    The score of the change needs a full window of changes, that of the level a year of days.
    """
    d = daily.withColumn("_k", F.lit(1))
    for c in ("spx", "qqq"):
        d = d.withColumn(f"{c}_ret", F.coalesce(R.change(F.col(c), R.whole(), days), F.lit(0.0)))
    d = d.withColumn("_dv", F.col("vix") - F.lag("vix").over(R.whole()))
    z = W.robust_zscore(F.col("vix"), rows, key="_k", min_rows=252)
    dz = W.robust_zscore(F.col("_dv"), rows, key="_k")
    d = d.withColumns({"vix_z": F.coalesce(z, F.lit(0.0)), "dvix_z": F.coalesce(dz, F.lit(0.0))})
    # Row `days` is the first with a past price; before it a return of 0 is no shock.
    price = (F.col("spx_ret") <= limit) | (F.col("qqq_ret") <= limit)
    vol = (F.col("vix_z") >= z_limit) & (F.col("dvix_z") >= dz_limit)
    d = d.withColumns({"price_shock": price, "vol_shock": vol})
    return d.withColumn("trigger", F.col("price_shock") | F.col("vol_shock")).drop("_k", "_dv")


def fast_overlay_state(shocks: DataFrame, params: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Overlay state per day and parameter set (name, duration in rows, exit return).

    A trigger starts the overlay; it ends after ``duration`` rows or once the return over the rows
    since (at most three steps) is above the exit level. The day it ends cannot start a new one.
    ``shocks(date, spx, trigger)`` is one row per day; sets are independent keys.
    """
    p = F.col("spx")
    steps = shocks.select(
        "date", "trigger",
        (p / F.lag(p, 2).over(R.whole()) - 1).alias("r2"), (p / F.lag(p, 3).over(R.whole()) - 1).alias("r3"),
    )
    sets = F.array(*(
        F.struct(F.lit(n).alias("params"), F.lit(int(k)).alias("duration"), F.lit(float(x)).alias("exit_at"))
        for n, k, x in params
    ))
    rows = steps.withColumn("_s", F.explode(sets)).select("_s.*", "date", "trigger", "r2", "r3")

    def step(state: Column, row: Column) -> tuple[Column, Column]:
        idle, hit, gone = state["gone"] < 0, row["trigger"], state["gone"] + 1
        expired = gone >= row["duration"]
        back = F.when(gone >= 4, row["r3"]).otherwise(row["r2"])
        recovered = F.coalesce((gone >= 3) & (back > row["exit_at"]), F.lit(False))
        now = F.when(idle, F.when(hit, 0).otherwise(-1)).when(expired | recovered, -1).otherwise(gone)
        since = F.when(idle, F.when(hit, row["date"])).when(~expired & ~recovered, state["since"])
        reason = (
            F.when(idle & hit, "triggered").when(idle, "inactive").when(expired, "duration_expired")
            .when(recovered, "recovery").otherwise("active")
        )
        left = F.when(now >= 0, row["duration"] - now).otherwise(0).cast("long")
        return F.struct(now.alias("gone"), since.alias("since")), F.struct(
            row["date"].alias("date"), (now >= 0).alias("is_active"), left.alias("days_remaining"),
            since.alias("trigger_date"), reason.alias("reason"),
        )

    zero = F.struct(F.lit(-1).alias("gone"), F.lit(None).cast("date").alias("since"))
    out = "date: date, is_active: boolean, days_remaining: bigint, trigger_date: date, reason: string"
    return fold_rows(rows, ["params"], "date", ["trigger", "r2", "r3", "duration", "exit_at"], zero, step, out)


def effective_regime(overlay: DataFrame, weekly: DataFrame) -> DataFrame:
    """Limits in force per day: the week's, tightened while the overlay is active."""
    d = overlay.withColumn("_k", F.lit(1))
    w = weekly.select(F.col("date").alias("_w"), "state", "group_cap", "cash_floor", F.lit(1).alias("_k"))
    d = J.asof_join(
        d.select("date", "_k").distinct(), w, ["_k"], "date", "_w", ["state", "group_cap", "cash_floor"]
    ).drop("_k")
    d = overlay.join(d.filter(F.col("state").isNotNull()), "date")
    on = F.col("is_active")
    return d.withColumns(
        {
            "effective_cap": F.when(on, F.least("group_cap", F.lit(FAST_CAP))).otherwise(F.col("group_cap")),
            "effective_floor": F.when(on, F.greatest("cash_floor", F.lit(FAST_FLOOR))).otherwise(F.col("cash_floor")),
            "effective_state": F.when(on, "fast_risk_off").otherwise(F.col("state")),
        }
    )


def decision_timeline(days: DataFrame, params: Sequence[tuple[str, int]]) -> DataFrame:
    """Action of each day per parameter set (name, quiet days after a fast trigger).

    ``days(date, is_weekly, trigger, stop)``. A weekly rebalance comes first, then a fast trigger
    more than the quiet days after the last one, then stops. Only days that could be a fast
    trigger go through the ordered pass.
    """
    sets = F.array(*(F.struct(F.lit(n).alias("params"), F.lit(int(k)).alias("quiet")) for n, k in params))
    rows = days.withColumn("_s", F.explode(sets)).select("_s.*", *days.columns)
    open_days = rows.filter(~F.col("is_weekly") & F.col("trigger")).select("params", "quiet", "date")

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        fire = last["day"].isNull() | (F.datediff(row["date"], last["day"]) > row["quiet"])
        day = F.when(fire, row["date"]).otherwise(last["day"])
        return F.struct(day.alias("day")), F.struct(row["date"].alias("date"), fire.alias("fire"))

    zero = F.struct(F.lit(None).cast("date").alias("day"))
    folded = fold_rows(open_days, ["params"], "date", ["quiet"], zero, step, "date: date, fire: boolean")
    fired = folded.filter("fire").drop("fire")
    d = rows.join(fired.withColumn("_fast", F.lit(True)), ["params", "date"], "left")
    action = (
        F.when(F.col("is_weekly"), "weekly")
        .when(F.col("_fast"), "fast_track_trigger")
        .when(F.col("stop"), "stop_loss_trigger")
        .otherwise("none")
    )
    return d.withColumn("action", action).drop("_fast", "quiet")
