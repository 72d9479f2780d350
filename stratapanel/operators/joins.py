"""As-of, bounded-range, membership and expansion joins.

Range conditions never become nested loops: an as-of join is a union and a window, a bounded
range is a short expansion of the small side and an equi-join, and calendar ranges go through
trading ordinals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.operators import calendar as C
from stratapanel.sources.scratch import cut_lineage


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    direction: str = "backward",
    prefix: str = "",
    bucket: str | None = None,
) -> DataFrame:
    """Add ``values`` of the nearest right row at or before (after) each left row.

    Without ``bucket`` a window per key is used: right when a key has a bounded number of rows.
    With ``bucket`` ("month", "quarter", ..) windows run per (key, bucket) and a small table of
    one row per key and bucket carries the last value over empty stretches, so a key that holds a
    large share of all rows is spread over as many tasks as it has buckets. Right rows must be
    unique per key and time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    return _asof(left, right, list(by), left_on, right_on, values, {direction: prefix}, bucket)


def _asof(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: Sequence[str],
    ways: Mapping[str, str], bucket: str | None,
) -> DataFrame:
    """As-of values in one or both directions (way -> column prefix) from one pass over both sides."""
    val = F.struct(*(F.col(v) for v in values))
    lrows = left.select(*by, F.col(left_on).alias("_t"), F.struct(*left.columns).alias("_l"))
    rrows = right.select(*by, F.col(right_on).alias("_t"), val.alias("_v"))
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    keys = list(by)
    if bucket:
        # the windows and the carry table read it: written once
        both = cut_lineage(both.withColumn("_b", F.trunc("_t", bucket)), "asof")
        keys.append("_b")
    # Right rows come first on equal times in the scan direction, so equality always matches.
    is_left = F.col("_l").isNotNull().cast("int")
    order = {"backward": F.col("_t"), "forward": F.col("_t").desc()}
    upto = {way: Window.partitionBy(*keys).orderBy(order[way], is_left).rowsBetween(Window.unboundedPreceding, 0) for way in ways}
    found = both.withColumns({f"_{way}": F.last("_v", ignorenulls=True).over(upto[way]) for way in ways})
    found = found.filter(F.col("_l").isNotNull())
    if bucket:
        at = F.when(F.col("_v").isNotNull(), F.col("_t"))
        edge = {"backward": F.max_by("_v", at), "forward": F.min_by("_v", at)}
        slots = both.groupBy(*keys).agg(*(edge[way].alias(f"_edge_{way}") for way in ways))
        along = {"backward": F.col("_b"), "forward": F.col("_b").desc()}
        carried = {
            f"_carry_{way}": F.last(f"_edge_{way}", ignorenulls=True).over(
                Window.partitionBy(*by).orderBy(along[way]).rowsBetween(Window.unboundedPreceding, -1)
            )
            for way in ways
        }
        carry = slots.select(*keys, *(c.alias(n) for n, c in carried.items()))
        found = found.join(carry, keys, "left")
        found = found.withColumns({f"_{way}": F.coalesce(f"_{way}", f"_carry_{way}") for way in ways})
    return found.select("_l.*", *(F.col(f"_{way}.{v}").alias(f"{p}{v}") for way, p in ways.items() for v in values))


def asof_features(fundamentals: DataFrame, prices: DataFrame, value: str) -> DataFrame:
    """Backward as-of of a price feature onto quarterly rows; rows without a finite one dropped."""
    d = asof_join(fundamentals, prices, ["tic"], "datadate", "date", [value])
    v = F.col(value)
    return d.filter(v.isNotNull() & (F.abs(v) < float("inf")))


def snapshot_as_of(dates: DataFrame, snapshots: DataFrame, date: str) -> DataFrame:
    """Latest snapshot date at or before each date (both lists are short)."""
    d = dates.select(F.col(date)).distinct().withColumn("_one", F.lit(1))
    s = snapshots.select("snap_date").distinct().withColumn("_one", F.lit(1))
    return asof_join(d, s, ["_one"], date, "snap_date", ["snap_date"]).drop("_one")


def pit_membership(
    rows: DataFrame, members: DataFrame | None, datadate: str = "datadate"
) -> DataFrame:
    """Rows whose ticker was a member at the trade date of their quarter.

    ``datadate`` is text; the synthetic dates stay, dates that map to no trade date go. Without a
    membership table nothing is filtered.
    """
    if members is None:
        return rows
    synthetic = F.col(datadate).isin("latest", "mixed")
    trade = C.datadate_to_tradedate(F.try_to_date(F.col(datadate)))
    d = rows.withColumn("_trade", F.when(~synthetic, trade))
    snaps = snapshot_as_of(d.filter(F.col("_trade").isNotNull()), members, "_trade")
    real = d.join(snaps, "_trade").join(members.select("snap_date", "tic").distinct(), ["snap_date", "tic"], "left_semi")
    return real.select(*rows.columns).unionByName(rows.filter(synthetic))


def members_in_quarter(snapshots: DataFrame) -> DataFrame:
    """(quarter_end, tic) for members of any snapshot in [quarter end - 3 months, quarter end].

    Each snapshot names the one or two quarters it counts for, so there is no range join.
    """
    end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
    nxt = F.last_day(F.add_months(end, 3))
    ends = F.array_compact(F.array(end, F.when(F.col("date") >= F.add_months(nxt, -3), nxt)))
    tics = F.split("tickers", ",")
    q = snapshots.select(F.explode(ends).alias("quarter_end"), tics.alias("t"))
    return q.select("quarter_end", F.explode("t").alias("tic")).select(
        "quarter_end", F.trim("tic").alias("tic")
    ).distinct()


def all_members(snapshots: DataFrame, start: str) -> DataFrame:
    """Every ticker that was a member in a snapshot since a date."""
    s = snapshots.filter(F.col("date") >= F.lit(start).cast("date"))
    return s.select(F.explode(F.split("tickers", ",")).alias("tic")).select(F.trim("tic").alias("tic")).distinct()


def missing_pairs(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected (tic, quarter_end) pairs without a stored row."""
    return expected.join(stored.select("tic", "quarter_end").distinct(), ["tic", "quarter_end"], "left_anti")


def quarter_coverage(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Members expected, tickers stored and their percentage per quarter."""
    e = expected.groupBy("quarter_end").agg(F.count("*").alias("expected"))
    s = stored.groupBy("quarter_end").agg(F.count_distinct("tic").alias("stored"))
    n = F.coalesce("stored", F.lit(0))
    return e.join(s, "quarter_end", "left").select(
        "quarter_end", "expected", n.alias("stored"), (n / F.col("expected") * 100).alias("coverage")
    )


def price_on_or_after(
    rows: DataFrame, prices: DataFrame, date: str, within: int | None = None, bucket: str | None = None
) -> DataFrame:
    """First price at or after a date (at most ``within`` days later), else the last before it."""
    p = prices.select("tic", F.col("date").alias("_pd"), F.col("close").alias("_px"))
    d = _asof(rows, p, ["tic"], date, "_pd", ["_pd", "_px"], {"forward": "_f", "backward": "_b"}, bucket)
    ahead = F.col("_f_px")
    if within is not None:
        ahead = F.when(F.datediff("_f_pd", date) <= within, ahead)
    return d.withColumn("price", F.coalesce(ahead, "_b_px")).drop("_f_pd", "_f_px", "_b_pd", "_b_px")


def price_on_or_before(rows: DataFrame, prices: DataFrame, date: str, bucket: str | None = None) -> DataFrame:
    """Last price at or before a date."""
    p = prices.select("tic", F.col("date").alias("_pd"), F.col("close").alias("price"))
    return asof_join(rows, p, ["tic"], date, "_pd", ["price"], bucket=bucket)


def price_nearest_bounded(rows: DataFrame, prices: DataFrame, date: str, reach: int = 5) -> DataFrame:
    """Price of the date, else of +1, -1, +2, -2 .. days, whichever comes first.

    The nearest price on each side comes from one pass over the dates asked for and the prices; of two as near the
    later one counts.
    """
    asked = rows.select("tic", date).distinct().filter(F.col("tic").isNotNull() & F.col(date).isNotNull())
    p = prices.select("tic", F.col("date").alias("_pd"), "close")
    d = _asof(asked, p, ["tic"], date, "_pd", ["_pd", "close"], {"forward": "_f", "backward": "_b"}, None)
    ahead, behind = F.datediff("_f_pd", date), F.datediff(date, "_b_pd")
    near = F.when((ahead <= reach) & ((ahead <= behind) | behind.isNull()), F.col("_fclose"))
    near = near.when(behind <= reach, F.col("_bclose"))
    return rows.join(d.select("tic", date, near.alias("price")), ["tic", date], "left")


def as_of_slice(df: DataFrame, as_of: str, lookback: int | None = None, inclusive: bool = True) -> DataFrame:
    """Rows at or before a date, the last ``lookback`` of each ticker."""
    d, day = F.col("date"), F.lit(as_of).cast("date")
    rows = df.filter(d <= day if inclusive else d < day)
    if lookback is None:
        return rows
    w = Window.partitionBy("tic").orderBy(d.desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= lookback).drop("_rn")


def align_common_dates(df: DataFrame, method: str = "forward", max_gaps: int = 2) -> DataFrame:
    """Rows on the union of all dates, long form: cells without a value have no row.

    ``forward`` carries a row over at most ``max_gaps`` following dates (0: any number), ``drop``
    keeps dates every ticker has, ``none`` keeps the rows. Only filled cells are produced, so the
    dates x tickers grid is never built.
    """
    values = [c for c in df.columns if c not in ("tic", "date")]
    if method == "none":
        return df
    if method == "drop":
        full = df.dropna(subset=values)
        size = df.agg(F.count_distinct("tic")).scalar()
        good = full.groupBy("date").agg(F.count("*").alias("n")).filter(F.col("n") == size)
        return full.join(good.select("date"), "date", "left_semi")
    if method != "forward":
        raise ValueError(f"unknown fill method {method!r}")
    ords = C.calendar_ordinals(df.select("date").distinct())
    w = Window.partitionBy("tic").orderBy("ord")
    d = df.join(ords, "date").withColumn("_next", F.lead("ord").over(w))
    last = ords.agg(F.max("ord")).scalar()
    stop = F.coalesce(F.col("_next") - 1, last)
    if max_gaps > 0:
        stop = F.least(stop, F.col("ord") + max_gaps)
    held = d.withColumn("ord", F.explode(F.sequence("ord", stop))).drop("date", "_next")
    return held.join(ords, "ord").select("tic", "date", *values)


def excess_residual(assets: DataFrame, base: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Asset return minus the return of a benchmark or of its group, on common dates only."""
    b = base.select(*keys, F.col("ret").alias("_base"))
    return assets.join(b, list(keys)).withColumn("excess", F.col("ret") - F.col("_base")).drop("_base")


def prediction_merge(bucketed: DataFrame, unified: DataFrame, sectors: DataFrame, fallback: DataFrame) -> DataFrame:
    """Unified predictions and sectors joined onto bucket predictions, sector with a fallback."""
    d = bucketed.join(unified, ["tic", "datadate"], "left").join(sectors, "tic", "left")
    f = fallback.select("tic", F.col("sector").alias("_fallback"))
    return d.join(f, "tic", "left").withColumn("sector", F.coalesce("sector", "_fallback")).drop("_fallback")


def activation_days(selections: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """For each trading day the selection that is active: from the next trading day after a
    selection until the next selection becomes active. Both lists are short."""
    s = C.nth_trading_day(selections.select(F.col(date)).distinct(), calendar, 1, "_from", date)
    # Two selections activated on one day: the later one is the one in force.
    s = s.filter(F.col("_from").isNotNull()).groupBy("_from").agg(F.max(date).alias(date))
    days = calendar.select("date", F.lit(1).alias("_one"))
    d = asof_join(days, s.withColumn("_one", F.lit(1)), ["_one"], "date", "_from", [date])
    return d.filter(F.col(date).isNotNull()).select("date", date)


def daily_universe_expand(
    selections: DataFrame, calendar: DataFrame, date: str = "trade_date", only: DataFrame | None = None
) -> DataFrame:
    """One row per trading day and active ticker, of all days or of those in ``only``."""
    days = activation_days(selections, calendar, date)
    if only is not None:
        days = days.join(only.select("date").distinct(), "date", "left_semi")
    return days.join(selections.select(date, "tic").distinct(), date).select("date", "tic").distinct()


def signal_expand_to_daily(
    signals: DataFrame, calendar: DataFrame, freq: str, universe: DataFrame | None = None
) -> DataFrame:
    """Signals on every trading day: W and M hold from one signal date to the next, D only on its
    own day (0 elsewhere, left out in long form). Outside the day's universe a signal is 0."""
    if freq == "D":
        daily = signals.join(calendar, "date", "left_semi")
    elif freq in ("W", "M"):
        starts = signals.select(F.col("date").alias("_start")).distinct()
        last = starts.agg(F.max("_start")).scalar()
        end = F.date_add(last, 7) if freq == "W" else F.when(
            F.last_day(last) == last, F.last_day(F.add_months(last, 1))
        ).otherwise(F.last_day(last))
        days = calendar.select("date", F.lit(1).alias("_one"))
        d = asof_join(days, starts.withColumn("_one", F.lit(1)), ["_one"], "date", "_start", ["_start"])
        d = d.filter(F.col("_start").isNotNull() & (F.col("date") < end)).select("date", "_start")
        s = signals.withColumnRenamed("date", "_start")
        daily = d.join(s, "_start").drop("_start")
    else:
        raise ValueError(f"unknown signal frequency {freq!r}")
    if universe is None:
        return daily
    u = universe.select("date", "tic", F.lit(True).alias("_in"))
    return daily.join(u, ["date", "tic"], "left").withColumn(
        "signal", F.when(F.col("_in"), F.col("signal")).otherwise(0)
    ).drop("_in")


def mixed_vintage(rows: DataFrame, members: DataFrame, cutoff: str) -> DataFrame:
    """Rows up to the cutoff, plus the latest later row of each current member dated 'mixed'."""
    cut = F.lit(cutoff).cast("date")
    text = F.date_format("datadate", "yyyy-MM-dd")
    train = rows.filter(F.col("datadate") <= cut).select(
        *(c for c in rows.columns if c != "datadate"), text.alias("datadate")
    )
    current = members.filter(F.col("snap_date") == members.agg(F.max("snap_date")).scalar())
    late = rows.filter(F.col("datadate") > cut).join(current.select("tic").distinct(), "tic", "left_semi")
    rest = [c for c in rows.columns if c != "tic"]
    last = late.groupBy("tic").agg(F.max_by(F.struct(*rest), "datadate").alias("r")).select("tic", "r.*")
    infer = last.select(
        *(c for c in rows.columns if c != "datadate"), F.lit("mixed").alias("datadate"), text.alias("original_datadate")
    )
    return train.unionByName(infer, allowMissingColumns=True)


def latest_snapshot(
    rows: DataFrame, universe: DataFrame, prices: DataFrame, cutoff: str, ref_date: str, end_date: str
) -> DataFrame:
    """Rows up to the cutoff, plus each member's latest row at the reference date dated 'latest'.

    The label of those is ln of the first price at or after the end date (else the last one known)
    over the first price at or after the reference date.
    """
    ref, end = F.lit(ref_date).cast("date"), F.lit(end_date).cast("date")
    text = F.date_format("datadate", "yyyy-MM-dd")
    others = [c for c in rows.columns if c not in ("datadate", "y_return")]
    train = rows.filter(F.col("datadate") <= F.lit(cutoff).cast("date")).select(
        *others, "y_return", text.alias("datadate")
    )
    known = rows.filter(F.col("datadate") <= ref).join(universe.select("tic").distinct(), "tic", "left_semi")
    rest = [c for c in rows.columns if c != "tic"]
    last = known.groupBy("tic").agg(F.max_by(F.struct(*rest), "datadate").alias("r")).select("tic", "r.*")
    d = F.col("date")
    px = prices.filter(d.between(F.date_sub(ref, 7), F.date_add(end, 3))).groupBy("tic").agg(
        F.min_by("close", F.when(d >= ref, d)).alias("_ref"),
        F.coalesce(F.min_by("close", F.when(d >= end, d)), F.max_by("close", d)).alias("_end"),
    )
    label = F.when(F.col("_ref") > 0, F.ln(F.col("_end") / F.col("_ref")))
    snap = last.join(px, "tic", "left").select(
        *others, label.alias("y_return"), F.lit("latest").alias("datadate")
    )
    return train.unionByName(snap)


def split_train_test(df: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Rows at or before a date, and rows after it."""
    day = F.lit(split).cast("date")
    return df.filter(F.col("date") <= day), df.filter(F.col("date") > day)


def leak_check(df: DataFrame, decision: str) -> DataFrame:
    """The table itself; evaluating a row dated after the decision date raises an error."""
    msg = F.concat(F.lit("row after the decision date: "), F.col("date").cast("string"))
    bad = F.when(F.col("date") > F.lit(decision).cast("date"), F.raise_error(msg))
    return df.filter(F.coalesce(bad.cast("boolean"), F.lit(True)))


def benchmark_align(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Series on the dates all of them have, each divided by its first value there.

    ``series``: name, date, value.
    """
    s = series.filter(F.col("name").isin(list(names)) & F.col("value").isNotNull())
    common = s.groupBy("date").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(names))
    s = s.join(common.select("date"), "date", "left_semi")
    w = Window.partitionBy("name").orderBy("date")
    return s.withColumn("level", F.col("value") / F.first("value").over(w))


def same_day_gap_adjust(preds: DataFrame, prices: DataFrame, execution: str) -> DataFrame:
    """Predictions minus what the ticker already moved on the last trading day.

    The move is between the last two trading days at or before the execution date; a ticker
    without both prices moved by 0.
    """
    days = prices.filter(F.col("date") <= F.lit(execution).cast("date")).select("date").distinct()
    two = days.orderBy(F.desc("date")).limit(2)
    hi = two.agg(F.max("date")).scalar()
    lo = two.agg(F.min("date")).scalar()
    move = prices.filter(F.col("date").isin(lo, hi)).groupBy("tic").agg(
        F.max(F.when(F.col("date") == lo, F.col("close"))).alias("_a"),
        F.max(F.when(F.col("date") == hi, F.col("close"))).alias("_b"),
    )
    gap = F.coalesce(F.try_divide(F.col("_b"), F.col("_a")) - 1, F.lit(0.0))
    return preds.join(move, "tic", "left").withColumns(
        {"realized": gap, "adjusted": F.col("pred") - gap}
    ).drop("_a", "_b")


def universe_events(members: DataFrame) -> DataFrame:
    """IN and OUT events between consecutive membership dates (date, tic).

    One row per ticker and date is compared with the ticker's own neighbours: a ticker enters
    when the universe's previous date is not the ticker's previous date, and leaves the same way
    forwards. Dates form a short table.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = members.select("date").distinct()
    dates = dates.withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("date").over(w)})
    t = Window.partitionBy("tic").orderBy("date")
    m = members.distinct().join(dates, "date").withColumns(
        {"_mine_prev": F.lag("date").over(t), "_mine_next": F.lead("date").over(t)}
    )
    enter = F.col("_prev").isNotNull() & ~F.col("_mine_prev").eqNullSafe(F.col("_prev"))
    leave = F.col("_next").isNotNull() & ~F.col("_mine_next").eqNullSafe(F.col("_next"))
    moves = F.array(
        F.when(enter, F.struct(F.col("date").alias("date"), F.lit("IN").alias("event"))),
        F.when(leave, F.struct(F.col("_next").alias("date"), F.lit("OUT").alias("event"))),
    )
    out = m.select("tic", F.explode(moves).alias("m")).filter(F.col("m").isNotNull())
    return out.select("m.date", "tic", "m.event")
