"""Trading calendars and date intervals.

A calendar is a table with one ``date`` column. It has at most one row per day, so windows over a
whole calendar and broadcasts of it stay small whatever the size of the price table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R



def trading_calendar(bounds: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Business days between ``start`` and ``end`` (one-row table, inclusive) minus holidays."""
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("date"))
    days = days.filter(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays, "date", "left_anti")


def filter_trading_days(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date is a trading day."""
    return df.join(calendar.select(F.col("date").alias(date)), date, "left_semi")


def week_end_dates(calendar: DataFrame) -> DataFrame:
    """Last trading day of every ISO week."""
    return (
        calendar.groupBy(
            F.extract(F.lit("YEAROFWEEK"), "date").alias("iso_year"),
            F.weekofyear("date").alias("iso_week"),
        )
        .agg(F.max("date").alias("date"))
        .select("date")
    )


def day_ordinals(calendar: DataFrame) -> DataFrame:
    """Every calendar day of the span with the number of trading days up to and before it."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    marked = days.join(calendar.select("date", F.lit(1).alias("open")), "date", "left")
    open_day = F.coalesce("open", F.lit(0))
    upto = F.sum(open_day).over(R.whole()).cast("long")
    return marked.select(
        "date",
        (open_day == 1).alias("is_open"),
        upto.alias("ord_upto"),
        (upto - open_day).alias("ord_before"),
    )


def calendar_ordinals(calendar: DataFrame) -> DataFrame:
    """Trading days numbered 1, 2, 3 .. in date order."""
    return calendar.select(
        "date", F.row_number().over(R.whole()).cast("long").alias("ord")
    )


def _with_ordinals(df: DataFrame, calendar: DataFrame, date: str, prefix: str) -> DataFrame:
    o = day_ordinals(calendar).select(
        F.col("date").alias(date),
        F.col("is_open").alias(f"{prefix}_open"),
        F.col("ord_upto").alias(f"{prefix}_upto"),
        F.col("ord_before").alias(f"{prefix}_before"),
    )
    # Dates outside the span lie before all trading days or after all of them.
    span = calendar.agg(F.struct(F.min("date").alias("lo"), F.count("date").alias("n"))).scalar()
    outside = F.when(F.col(date) < F.col("_span.lo"), F.lit(0)).when(
        F.col(date).isNotNull(), F.col("_span.n")
    )
    return df.join(o, date, "left").withColumn("_span", span).withColumns(
        {c: F.coalesce(c, outside) for c in (f"{prefix}_upto", f"{prefix}_before")}
    ).drop("_span")


def trading_days_between(
    df: DataFrame, calendar: DataFrame, start: str = "start", end: str = "end"
) -> DataFrame:
    """Add ``both``, ``left``, ``right`` and ``neither``: trading days between two dates.

    Counts come from ordinals (two equi-joins), not from a range join.
    """
    d = _with_ordinals(_with_ordinals(df, calendar, start, "_s"), calendar, end, "_e")

    def count(a: str, b: str) -> Column:
        return F.when(F.col(start) > F.col(end), F.lit(0)).otherwise(
            F.greatest(F.col(a) - F.col(b), F.lit(0))
        ).cast("long")

    return d.withColumns(
        {
            "both": count("_e_upto", "_s_before"),
            "left": count("_e_before", "_s_before"),
            "right": count("_e_upto", "_s_upto"),
            "neither": count("_e_before", "_s_upto"),
        }
    ).drop("_s_open", "_s_upto", "_s_before", "_e_open", "_e_upto", "_e_before")


def _lookup(df: DataFrame, calendar: DataFrame, ord_col: Column, name: str) -> DataFrame:
    o = calendar_ordinals(calendar).select(F.col("date").alias(name), F.col("ord").alias("_ord"))
    return df.withColumn("_ord", ord_col).join(o, "_ord", "left").drop("_ord")


def nth_trading_day(
    df: DataFrame, calendar: DataFrame, n: int, name: str, date: str = "date", strict: bool = False
) -> DataFrame:
    """Add the n-th trading day after (n > 0) or before (n < 0) a date, itself excluded.

    Too few days give null, or an error when ``strict``.
    """
    if n == 0:
        raise ValueError("n must not be 0")
    d = _with_ordinals(df, calendar, date, "_d")
    target = F.col("_d_upto") + n if n > 0 else F.col("_d_before") + (n + 1)
    out = _lookup(d, calendar, target, name).drop("_d_open", "_d_upto", "_d_before")
    if strict:
        out = out.withColumn(
            name, F.coalesce(name, F.raise_error(F.lit("not enough trading days")).cast("date"))
        )
    return out


def align_to_trading_day(
    df: DataFrame, calendar: DataFrame, how: str, name: str, date: str = "date"
) -> DataFrame:
    """Add the trading day a date is moved to: forward, backward or nearest (a tie goes forward)."""
    d = _with_ordinals(df, calendar, date, "_d")
    back = _lookup(d, calendar, F.col("_d_upto"), "_back")
    both = _lookup(back, calendar, F.col("_d_before") + 1, "_fwd")
    picks = {
        "forward": F.col("_fwd"),
        "backward": F.col("_back"),
        "nearest": F.when(
            F.col("_back").isNull()
            | (F.datediff("_fwd", date) <= F.datediff(date, "_back")),
            F.col("_fwd"),
        ).otherwise(F.coalesce("_back", "_fwd")),
    }
    if how not in picks:
        raise ValueError(f"unknown alignment {how!r}")
    return both.withColumn(name, picks[how]).drop(
        "_back", "_fwd", "_d_open", "_d_upto", "_d_before"
    )


def missing_trading_days(
    tickers: DataFrame, existing: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Trading days a ticker has no row for, from its ``first_added`` day on.

    Per ticker the days present become one set of ordinals (bounded by the calendar), and only
    the missing ordinals are expanded: no ticker x calendar product is made.
    """
    o = calendar_ordinals(calendar)
    span = o.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    seen = existing.join(o, "date").groupBy("tic").agg(F.collect_set("ord").alias("seen"))
    first = _with_ordinals(tickers, calendar, "first_added", "_f").withColumn(
        "_from", F.coalesce(F.col("_f_before") + 1, F.lit(1))
    )
    hi = span.select("hi").scalar()
    want = F.when(F.col("_from") <= hi, F.sequence(F.col("_from"), hi))
    gaps = first.join(seen, "tic", "left").select(
        "tic",
        F.explode(
            F.array_except(want, F.coalesce("seen", F.array().cast("array<bigint>")))
        ).alias("ord"),
    )
    return gaps.join(o, "ord").select("tic", "date")


def consolidate_date_ranges(
    df: DataFrame, keys: list[str], position: str | None = None
) -> DataFrame:
    """Islands of consecutive dates per key. ``position`` may name a trading ordinal to use
    instead of calendar days, so that a weekend does not split a range."""
    d = df.select(*keys, "date", *([position] if position else [])).distinct()
    w = Window.partitionBy(*keys).orderBy("date")
    if position:
        step = F.col(position) - F.lag(position).over(w)
    else:
        step = F.datediff("date", F.lag("date").over(w))
    d = d.withColumn("_new", F.when(step <= 1, 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(w))
    return d.groupBy(*keys, "_island").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")
    ).drop("_island")


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or adjacent [start, end] day intervals per key.

    Intervals with the same start collapse first (map-side), so a key holds at most one row per
    day however many intervals were logged for it.
    """
    d = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(F.col("start") <= F.date_add(reach, 1), 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(w))
    return d.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("_island")


def interval_gaps(requests: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of a requested [start, end] per key that no logged interval covers."""
    asked = requests.select(*keys, F.col("start").alias("_rs"), F.col("end").alias("_re")).filter(
        F.col("_rs") <= F.col("_re")
    )
    covered = asked.join(merge_intervals(log, keys), keys, "left")
    meets = (F.col("end") >= F.col("_rs")) & (F.col("start") <= F.col("_re"))
    covered = covered.select(
        *keys,
        "_rs",
        "_re",
        F.when(meets, F.greatest("start", "_rs")).alias("_cs"),
        F.when(meets, F.least("end", "_re")).alias("_ce"),
    )
    w = Window.partitionBy(*keys, "_rs", "_re").orderBy(F.col("_cs").asc_nulls_last())
    before = F.coalesce(F.date_add(F.lag("_ce").over(w), 1), F.col("_rs"))
    gaps = covered.withColumns(
        {
            "_gap_start": before,
            "_gap_end": F.coalesce(F.date_sub("_cs", 1), F.col("_re")),
            "_tail": F.lead("_cs").over(w).isNull() & F.col("_cs").isNotNull(),
            "_place": F.row_number().over(w),
        }
    )
    # A key without a meeting interval keeps one all-null row: its gap is the whole request. Null
    # rows next to real ones say nothing.
    gaps = gaps.filter(F.col("_cs").isNotNull() | (F.col("_place") == 1))
    pieces = F.array(
        F.struct(F.col("_gap_start").alias("start"), F.col("_gap_end").alias("end")),
        F.when(
            F.col("_tail"),
            F.struct(F.date_add("_ce", 1).alias("start"), F.col("_re").alias("end")),
        ),
    )
    return (
        gaps.select(*keys, F.explode(pieces).alias("g"))
        .filter(F.col("g").isNotNull() & (F.col("g.start") <= F.col("g.end")))
        .select(*keys, "g.start", "g.end")
        .distinct()
    )


def month_end_rebalance_dates(calendar: DataFrame) -> DataFrame:
    """Week-ends that close a month: the month's last day, or the last before the month turns."""
    d = F.col("date")
    closes = (F.last_day(d) == d) | (F.month(F.date_add(d, 7)) != F.month(d))
    return week_end_dates(calendar).filter(closes)


def rebalance_day_flag(calendar: DataFrame) -> DataFrame:
    """Flags per trading day: every day, first day of the ISO week inside its calendar year, and
    the second and the last trading day of the month (the first where there is only one)."""
    y, m, wk = F.year("date"), F.month("date"), F.weekofyear("date")
    week = Window.partitionBy(y, wk).orderBy("date")
    month = Window.partitionBy(y, m)
    place = F.row_number().over(month.orderBy("date"))
    size = F.count("*").over(month)
    return calendar.select(
        "date",
        F.lit(True).alias("daily"),
        (F.row_number().over(week) == 1).alias("weekly"),
        ((place == F.least(F.lit(2), size)) | (place == size)).alias("monthly"),
    )


def datadate_to_tradedate(d: Column) -> Column:
    """Quarter end to the day it may be traded; any other date gives null."""
    day = F.date_format(d, "MM-dd")
    y = F.year(d)
    return (
        F.when(day == "03-31", F.make_date(y, F.lit(6), F.lit(1)))
        .when(day == "06-30", F.make_date(y, F.lit(9), F.lit(1)))
        .when(day == "09-30", F.make_date(y, F.lit(12), F.lit(1)))
        .when(day == "12-31", F.make_date(y + 1, F.lit(3), F.lit(1)))
    )


def quarter_align_mjsd(d: Column) -> Column:
    """First day of the March/June/September/December that follows the date's season."""
    season = F.trunc(F.add_months(d, 1), "quarter")  # Dec-Feb -> Jan 1, Mar-May -> Apr 1, ..
    return F.add_months(season, 2)


def statement_quarter_key(year: Column, period: Column, d: Column) -> Column:
    """Quarter end of a statement: from year and period when both are usable, else from its date."""
    p = F.upper(period)
    month = F.when(p == "FY", 12).when(
        p.isin("Q1", "Q2", "Q3", "Q4"), F.substring(p, 2, 1).cast("int") * 3
    )
    named = F.last_day(F.make_date(year, month, F.lit(1)))
    return F.coalesce(named, F.last_day(F.add_months(F.trunc(d, "quarter"), 2)))


def effective_trade_cutoff(
    as_of: DataFrame, available: DataFrame, lag_quarters: int = 2
) -> DataFrame:
    """Latest available quarter not after the end of (as_of quarter - lag); else the earliest.

    ``available`` is the short list of quarter ends, carried as one array value.
    """
    quarters = available.agg(F.array_sort(F.collect_set("datadate")).alias("q")).scalar()
    target = F.last_day(F.add_months(F.trunc("as_of", "quarter"), 2 - 3 * max(lag_quarters, 0)))
    d = as_of.withColumn("_q", quarters).withColumn("_t", target)
    best = F.expr("array_max(filter(_q, x -> x <= _t))")
    return d.select(*as_of.columns, F.coalesce(best, F.array_min("_q")).alias("cutoff"))


def actual_trade_date(
    df: DataFrame, calendar: DataFrame, date: str, name: str, within: int = 10
) -> DataFrame:
    """First trading day on or after a date within some days, else the date itself."""
    moved = align_to_trading_day(df, calendar, "forward", "_moved", date)
    ok = F.datediff("_moved", date) <= within
    return moved.withColumn(name, F.when(ok, F.col("_moved")).otherwise(F.col(date))).drop("_moved")
