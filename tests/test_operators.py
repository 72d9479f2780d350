"""Known values and invariants on tiny tables."""

import datetime as dt
import math
import random
import re
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.functions.order_stats import grouped_quantiles, grouped_rank
from stratapanel.operators import backtest as Q
from stratapanel.operators import calendar as C
from stratapanel.operators import features as W
from stratapanel.operators import joins as J
from stratapanel.operators import portfolio as B
from stratapanel.operators import ranking as X
from stratapanel.operators import user as U


def d(text):
    return dt.date.fromisoformat(text)


def days(spark, *texts):
    return spark.createDataFrame([(d(t),) for t in texts], "date date")


def test_label_chain(spark):
    prices = [114.63, 162.32, 219.76, 198.62]
    q = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31"]
    df = spark.createDataFrame([("A", d(x), p) for x, p in zip(q, prices)], "tic string, datadate date, price double")
    got = [r[0] for r in df.withColumn("y", W.forward_log_return(F.col("price"))).orderBy("datadate").select("y").collect()]
    assert [None if x is None else round(x, 4) for x in got] == [0.3479, 0.3030, -0.1011, None] 


def test_mad_of_small_series(spark):
    df = spark.createDataFrame([("A", float(x)) for x in (1, 2, 3, 10)], "tic string, x double")
    assert W.mad(df, ["tic"], "x").first()["mad"] == 1.0


def test_saturday_alignment(spark):
    cal = days(spark, "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08")
    sat = days(spark, "2024-01-06")
    f = C.align_to_trading_day(sat, cal, "forward", "x").first()["x"]
    b = C.align_to_trading_day(sat, cal, "backward", "x").first()["x"]
    n = C.align_to_trading_day(sat, cal, "nearest", "x").first()["x"]
    assert (f, b, n) == (d("2024-01-08"), d("2024-01-05"), d("2024-01-05"))


def test_missing_days_and_islands(spark):
    cal = days(spark, *(f"2024-01-{k:02d}" for k in (2, 3, 4, 5, 8, 9, 10)))
    have = days(spark, "2024-01-02", "2024-01-03", "2024-01-08", "2024-01-09").withColumn("tic", F.lit("A"))
    t = spark.createDataFrame([("A", d("2024-01-01"))], "tic string, first_added date")
    m = C.missing_trading_days(t, have, cal)
    assert sorted(str(r["date"]) for r in m.collect()) == ["2024-01-04", "2024-01-05", "2024-01-10"]
    r = C.consolidate_date_ranges(m, ["tic"]).orderBy("start").collect()
    assert [(str(x["start"]), str(x["end"])) for x in r] == [("2024-01-04", "2024-01-05"), ("2024-01-10", "2024-01-10")]


@pytest.mark.parametrize("price,kind", [(105.0, None), (94.0, "absolute"), (98.0, "trailing")])
def test_stops(spark, price, kind):
    rows = [("A", d("2024-01-01"), 100.0, d("2024-01-02"), 110.0), ("A", d("2024-01-01"), 100.0, d("2024-01-03"), price)]
    p = spark.createDataFrame(rows, "tic string, entry_date date, entry_price double, date date, close double")
    got = [r["kind"] for r in B.stop_loss(p).collect()]
    assert got == ([kind] if kind else [])


@pytest.mark.parametrize("zs,n,ok", [((2.6, 2.7, 2.8, 2.9), 4, True), ((2.6, 2.0, 2.1, 2.2), 1, False), ((2.0, 2.1, 2.2, 2.3), 0, False)])
def test_persistence_exceptions(spark, zs, n, ok):
    rows = [("A", d("2024-01-01") + dt.timedelta(weeks=i), z) for i, z in enumerate(zs)]
    r = X.exception_mk(spark.createDataFrame(rows, "tic string, date date, z double")).orderBy(F.desc("date")).first()
    assert (r["trigger_count"], r["mk"]) == (n, ok)


def test_membership_dates(spark):
    rows = spark.createDataFrame([("N", x) for x in ("2025-03-31", "2025-09-30", "2025-12-31")], "tic string, datadate string")
    m = spark.createDataFrame([(d("2020-01-01"), "O"), (d("2026-02-09"), "O"), (d("2026-02-09"), "N")], "snap_date date, tic string")
    assert [r["datadate"] for r in J.pit_membership(rows, m).collect()] == ["2025-12-31"]


def test_quantiles_and_ranks_match_numpy(spark):
    rnd = random.Random(7)
    rows = []
    for g in "ab":
        vals = [rnd.gauss(0, 1) for _ in range(200)] + [0.0] * 50 + [1.5] * 120 + [-1e6, 1e6, None]
        rows += [(g, f"t{i}", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, t string, v double")
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}).collect()}
    for g in "ab":
        vals = [v for k, _, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(vals)
        for name, p in (("lo", 0.01), ("mid", 0.5), ("hi", 0.99)):
            assert math.isclose(got[g][name], float(np.quantile(vals, p)), rel_tol=1e-12, abs_tol=1e-12)
    pdf = pd.DataFrame(rows, columns=["g", "t", "v"])
    pdf["want"] = pdf.groupby("g")["v"].rank(ascending=False)
    pdf = pdf.merge(grouped_rank(df, ["g"], "v").toPandas()[["g", "t", "rank"]], on=["g", "t"])
    assert ((pdf["want"] == pdf["rank"]) | (pdf["want"].isna() & pdf["rank"].isna())).all()


def test_min_variance_two_independent_names(spark):
    rng = np.random.default_rng(3)
    q = pd.date_range("2020-03-31", periods=9, freq="QE")
    rows = []
    for tic, vol in (("A", 0.02), ("B", 0.08)):
        p = 100 * np.cumprod(1 + rng.normal(0, vol, 9))
        rows += [(tic, x.date(), float(v)) for x, v in zip(q, p)]
    prices = spark.createDataFrame(rows, "tic string, datadate date, price double")
    sel = spark.createDataFrame([(q[-1].date(), "A"), (q[-1].date(), "B"), (q[-1].date(), "C")], "date date, tic string")
    w = {r["tic"]: r["weight"] for r in B.min_variance_weights(sel, prices).collect()}
    wide = prices.toPandas().pivot(index="datadate", columns="tic", values="price").iloc[-8:].pct_change().iloc[1:]
    c = wide.cov().values
    grid = np.linspace(0, 1, 20001)
    best = grid[np.argmin([np.array([a, 1 - a]) @ c @ np.array([a, 1 - a]) for a in grid])]
    assert math.isclose(sum(w.values()), 1.0, abs_tol=1e-9) and w["C"] == 0.0
    assert abs(w["A"] - best) < 1e-3


def test_step_weights_by_hand(spark):
    rows = []
    plan = {"A": [1, 1, 0, 1, 1], "B": [1, -1, -1, 1, 1]}
    inside = {"A": [True] * 5, "B": [True, True, True, False, False]}
    for tic, sig in plan.items():
        for i, s in enumerate(sig):
            rows.append((d("2024-01-01") + dt.timedelta(days=i), i + 1, tic, s, inside[tic][i], True))
    s = spark.createDataFrame(rows, "date date, ord long, tic string, signal int, in_universe boolean, is_rebalance boolean")
    out = B.step_weights(s, [{"name": "p", "cooling": 2, "max_weight": 0.2}]).collect()
    got = {(r["tic"], r["date"].day): (round(r["weight"], 6), r["action"]) for r in out}
    assert got == {
        ("A", 1): (0.2, "OPEN_LONG"), ("A", 2): (0.2, "HOLD"),
        ("A", 5): (0.2, "OPEN_LONG"),  # stopped on day 3, quiet on day 4
        ("B", 1): (0.2, "OPEN_LONG"), ("B", 2): (-0.2, "FLIP"), ("B", 3): (-0.2, "HOLD"),
    }
    small = B.step_weights(s, [{"name": "p", "max_weight": 0.4, "gross": 0.5, "max_positions": 1, "allow_short": False}])
    assert {(r["tic"], r["date"].day, round(r["weight"], 6)) for r in small.collect()} == {("A", k, 0.4) for k in (1, 2, 4, 5)}


def test_min_variance_meets_the_optimality_conditions():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 8, 40):
        for rows in (3, k + 5):
            x = rng.normal(size=(rows, k)) * rng.uniform(0.1, 2, k)
            cov = np.atleast_2d(np.cov(x, rowvar=False))
            w = B._min_variance(x)
            assert (w >= 0).all() and math.isclose(w.sum(), 1.0, abs_tol=1e-9)
            # at the optimum no name has a lower marginal variance than the held ones
            slope = cov @ w
            assert slope.min() >= w @ slope - 1e-6 * max(np.trace(cov) / k, 1e-12)
    assert B._min_variance(np.zeros((3, 3))).tolist() == [1 / 3] * 3
    two = B._min_variance(np.array([[0.04, 0.01], [0.01, 0.09]]))
    assert math.isclose(two[0], (0.09 - 0.01) / (0.04 + 0.09 - 0.02), rel_tol=1e-6)  # closed form


def test_walk_forward_tells_what_failed(spark):
    rows = [(d("2024-01-01") + dt.timedelta(days=i), k, float(i)) for i in range(30) for k in ("x", "y")]
    data = spark.createDataFrame(rows, "date date, name string, v double")
    dates = data.select("date").distinct()
    periods = Q.walk_forward_periods(dates, dates, 20, "rolling", 5)

    def shaky(key, part):
        if key[1] == "y" and key[0].day == 25:
            raise ValueError("bad day")
        return pd.DataFrame({"decision_date": [key[0]], "name": [key[1]], "m": [part["v"].mean()]})

    got = Q.walk_forward_run(periods, data, shaky, "decision_date date, name string, m double", by=["name"]).collect()
    assert len(got) == 19 + 2 * 11
    bad = [r for r in got if r["error"] and "bad day" in r["error"]]
    assert [(r["decision_date"].day, r["name"], r["m"]) for r in bad] == [(25, "y", None)]
    assert sum(r["error"] == "not enough data before" for r in got) == 19
    assert all(r["m"] is not None for r in got if r["error"] is None)


def test_first_rank_spreads_ties_by_the_tie_break(spark):
    rows = [("g", f"S{i}", float(i % 3 - 1)) for i in range(300)] + [("g", "none", None)]
    df = spark.createDataFrame(rows, "g string, tic string, v double")
    got = {r["tic"]: r["rank"] for r in grouped_rank(df, ["g"], "v", method="first", tie_break=["tic"]).collect()}
    order = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1]))
    assert got.pop("none") is None
    assert got == {r[1]: i + 1 for i, r in enumerate(order)}


def test_asof_bucketed_equals_plain(spark):
    rnd = random.Random(1)
    days_ = [d("2020-01-01") + dt.timedelta(days=k) for k in range(400)]
    right = spark.createDataFrame([(t, x, rnd.random()) for t in "AB" for x in rnd.sample(days_, 60)], "tic string, date date, v double")
    left = spark.createDataFrame([(t, rnd.choice(days_)) for t in "ABC" for _ in range(80)], "tic string, at date")
    for way in ("backward", "forward"):
        a = J.asof_join(left, right, ["tic"], "at", "date", ["v"], way).collect()
        b = J.asof_join(left, right, ["tic"], "at", "date", ["v"], way, bucket="month").collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_leak_check_raises(spark):
    with pytest.raises(Exception, match="after the decision date"):
        J.leak_check(days(spark, "2024-01-01", "2024-01-05"), "2024-01-03").collect()


def test_future_rows_do_not_change_the_past(spark):
    rnd = random.Random(5)
    rows = [("A", d("2020-01-01") + dt.timedelta(days=k), 100 + rnd.random()) for k in range(60)]
    schema = "tic string, date date, close double"
    short = spark.createDataFrame(rows[:40], schema).withColumn("z", W.robust_zscore(F.col("close"), 12))
    full = spark.createDataFrame(rows, schema).withColumn("z", W.robust_zscore(F.col("close"), 12))
    want = {r["date"]: r["z"] for r in short.collect()}
    got = {r["date"]: r["z"] for r in full.collect() if r["date"] in want}
    assert got == want
    last = [c for _, _, c in rows[28:40]]
    med = statistics.median(last)
    mad = statistics.median(abs(x - med) for x in last)
    assert math.isclose(want[rows[39][1]], (last[-1] - med) / mad)


def test_cost_properties(spark):
    t = spark.createDataFrame([("s", 1000.0, 0.02, 0.1)], "strategy string, traded double, volatility double, participation double")
    flat = Q.total_costs(t, Q.flat_cost(0.001)).first()["cost"]
    assert math.isclose(Q.total_costs(t, Q.impact_cost(0, 0, 0.001)).first()["cost"], flat)
    full, half = (r["cost"] for r in Q.liquidity_sweep(t, Q.impact_cost(1, 1, 0.0), (1.0, 0.5)).orderBy(F.desc("scale")).collect())
    assert math.isclose(half, 2 * full)


def test_stop_stream_over_batches_equals_batch(spark):
    from stratapanel.sources import scratch
    from stratapanel.streaming import jobs

    rnd = random.Random(2)
    rows = []
    for tic, days in (("A", 120), ("B", 20), ("C", 120)):  # B is closed early
        p = 100.0
        for k in range(days):
            p *= 1 + rnd.gauss(0, 0.02)
            rows.append((tic, d("2020-01-01"), 100.0, d("2020-01-01") + dt.timedelta(days=k), p))
    schema = "tic string, entry_date date, entry_price double, date date, close double"
    df = spark.createDataFrame(rows, schema)
    order = sorted(rows, key=lambda r: r[3] + dt.timedelta(days=rnd.randint(0, 6)))  # up to six days out of order
    rnd.shuffle(order[:100])
    parts = [spark.createDataFrame(order[a:b], schema) for a, b in ((0, 80), (80, 160), (160, 220), (220, 260))]
    out, check = scratch.new_path(spark, "out"), scratch.new_path(spark, "check")
    told = jobs.run_parts(
        parts, "stop-in", lambda s: jobs.start(jobs.stop_loss_stream(s, late_days=7, idle_days=30), out, check)
    )
    got = sorted((r["tic"], str(r["date"]), r["kind"]) for r in spark.read.parquet(out).collect())
    last = max(r[3] for r in rows) - dt.timedelta(days=7)
    want = sorted((r["tic"], str(r["date"]), r["kind"]) for r in B.stop_loss(df).collect() if r["date"] < last)
    assert got == want and want
    assert told[0]["stateOperators"][0]["numRowsTotal"] == 3
    assert told[-1]["stateOperators"][0]["numRowsTotal"] == 2  # the closed position left no state


def test_positions_of_a_ticker_share_a_state(spark):
    from stratapanel.sources import scratch
    from stratapanel.streaming import jobs

    rnd = random.Random(3)
    rows = []
    for tic, start, days in (("A", 0, 90), ("A", 10, 15), ("A", 60, 60), (None, 0, 120)):  # the second is closed early
        first, p = d("2020-01-01") + dt.timedelta(days=start), 100.0
        for k in range(days):
            p *= 1 + rnd.gauss(0, 0.03)
            rows.append((tic, first, 100.0, first + dt.timedelta(days=k), p))
    schema = "tic string, entry_date date, entry_price double, date date, close double"
    rows.sort(key=lambda r: r[3])
    edges = [0, 60, 140, 200, len(rows)]
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in zip(edges, edges[1:])]
    out, check = scratch.new_path(spark, "out"), scratch.new_path(spark, "check")
    told = jobs.run_parts(parts, "share-in", lambda s: jobs.start(jobs.stop_loss_stream(s, idle_days=30), out, check))
    last = max(r[3] for r in rows) - dt.timedelta(days=7)
    key = lambda r: (str(r["tic"]), r["entry_date"], r["date"], r["kind"])
    got = sorted(key(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(key(r) for r in B.stop_loss(spark.createDataFrame(rows, schema)).collect() if r["date"] < last) and got
    assert len({r[1] for r in got if r[0] == "A"}) > 1
    assert told[0]["stateOperators"][0]["numRowsTotal"] == 2  # one for each ticker


def test_only_ranges_that_are_not_logged_are_taken(spark):
    from stratapanel.sources import scratch
    from stratapanel.streaming import jobs

    def rows(tic, first, last, price):
        days = (d(last) - d(first)).days + 1
        return [(tic, d(first) + dt.timedelta(days=k), price, k) for k in range(days)]

    batches = [
        rows("A", "2020-01-10", "2020-01-20", 1.0) + rows("B", "2020-01-01", "2020-01-02", 1.0),
        rows("A", "2020-01-10", "2020-01-20", 2.0),  # a replay
        rows("A", "2020-01-05", "2020-01-25", 3.0) + rows("A", "2020-01-07", "2020-01-07", 4.0),
        rows("A", "2020-01-01", "2020-01-30", 5.0) + rows("B", "2020-01-04", "2020-01-04", 5.0),
    ]
    schema = "tic string, date date, close double, k long"
    at, log, check = (scratch.new_path(spark, n) for n in ("rows", "log", "check"))
    jobs.run_parts(
        [spark.createDataFrame(b, schema) for b in batches], "fetch",
        lambda s: jobs.incremental_upsert(s, ["tic", "date"], "k", at, log, check),
    )
    got = {(r.tic, r.date.day): r.close for r in jobs.resolve_upserts(spark, at, ["tic", "date"], "k").collect()}
    want = {("A", x): 1.0 if 10 <= x <= 20 else 3.0 if 5 <= x <= 25 else 5.0 for x in range(1, 31)}
    assert got == want | {("B", 1): 1.0, ("B", 2): 1.0, ("B", 4): 5.0}
    logged = sorted((r.batch, r.tic, r.start.day, r.end.day, r.rows) for r in spark.read.parquet(log).collect())
    assert logged == [
        (0, "A", 10, 20, 11), (0, "B", 1, 2, 2), (2, "A", 5, 9, 6), (2, "A", 21, 25, 5),
        (3, "A", 1, 4, 4), (3, "A", 26, 30, 5), (3, "B", 4, 4, 1),
    ]


def test_at_most_so_many_names_are_held(spark):
    import hashlib

    names = [f"T{i}" for i in range(57)]
    signals = spark.createDataFrame([(d("2020-01-02"), t, 1 if i % 9 else 0) for i, t in enumerate(names)], "date date, tic string, signal int")
    events = spark.createDataFrame([(d("2020-01-02"), "signal"), (d("2020-01-31"), "month_end")], "date date, kind string")
    got = B.event_weights(signals, events).collect()
    able = [t for i, t in enumerate(names) if i % 9]
    want = sorted(able, key=lambda t: hashlib.md5(f"2020-01-02{t}".encode()).hexdigest())[:20]
    assert sorted(r.tic for r in got) == sorted(want * 2) and {r.weight for r in got} == {0.05}


def test_rolling_models_impute_and_tell_all_errors(spark):
    from stratapanel.operators import models as M

    rng = random.Random(4)
    ends = [x.date() for x in pd.date_range("2020-03-31", periods=12, freq="QE") if x.month != 9]  # quarters are missing
    rows = []
    for q in ends:
        for i in range(12):
            x, z = rng.random(), rng.random()
            rows.append((f"T{i}", q, x if i else None, z, None if q == ends[-1] else 2 * x - z))
    df = spark.createDataFrame(rows, "tic string, datadate date, x double, z double, y_return double")
    sizes = {"trees": 3, "depth": 2, "rounds": 2}
    got = M.rolling_train_single(df, ["x", "z"], str(ends[-1]), 2, 3, sizes_of=sizes).collect()
    assert len(got) == 12  # the row without a factor is predicted too
    assert {r["model"] for r in got} == {"ridge"}
    errors = got[0]["model_errors"]
    assert set(errors) == {"ridge", "forest", "boosted"} and min(errors.values()) == got[0]["model_mse"]
    every = M.rolling_train_all(df, ["x", "z"], [str(q) for q in ends[4:]], 3, 1, names=("ridge",)).collect()
    assert len(every) == 12 * len(ends[4:])
    assert M.rolling_train_single(df, ["x", "z"], str(ends[0]), 2) is None


def test_symbols_that_are_bad_or_absent_can_be_skipped(spark, tmp_path):
    from stratapanel.sources.prices import price_csv_scan

    head = "date,open,high,low,close,volume\n"
    (tmp_path / "GOOD_daily.csv").write_text(head + "2024-01-02,1,2,1,2,5\n")
    (tmp_path / "BAD_daily.csv").write_text("when,open\n2024-01-02,1\n")
    names = ["GOOD", "BAD", "ABSENT"]
    got = price_csv_scan(spark, str(tmp_path), symbols=names, required=False).collect()
    assert [(r["tic"], r["close"]) for r in got] == [("GOOD", 2.0)]
    with pytest.raises(Exception):
        price_csv_scan(spark, str(tmp_path), symbols=names).collect()
    with pytest.raises(Exception):
        price_csv_scan(spark, str(tmp_path), symbols=["GOOD", "BAD"]).collect()


def _table_solver(cov):
    """The same problem through the names' table: names enter one by one, and leave when they turn negative."""
    k = len(cov)
    cov = cov / (np.trace(cov) / k) + 1e-10 * np.eye(k)
    x, held = np.zeros(k), np.zeros(k, dtype=bool)
    while True:
        gain = np.where(held, -np.inf, 1.0 - cov @ x)
        if held.all() or gain.max() <= 1e-9:
            return x / x.sum()
        held[int(np.argmax(gain))] = True
        while True:
            z = np.zeros(k)
            z[held] = np.linalg.solve(cov[np.ix_(held, held)], np.ones(held.sum()))
            out = held & (z <= 0)
            if not out.any():
                break
            part = np.min(x[out] / (x[out] - z[out]))
            x = x + part * (z - x)
            held &= ~(out & (x <= 1e-15))
            x[~held] = 0.0
        x = z


def test_least_variance_through_the_rows():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 5, 7, 9, 14, 25):
        for _ in range(8):
            r = rng.normal(0.01, 0.05, (7, k)) + rng.normal(0, 0.04, (7, 1))
            cov = np.atleast_2d(np.cov(r, rowvar=False))
            got, want = B._min_variance(r), _table_solver(cov)
            assert abs(got.sum() - 1) < 1e-9 and (got >= 0).all()
            assert got @ cov @ got <= want @ cov @ want + 1e-9 * np.trace(cov)
            if k <= 6:
                assert np.allclose(got, want, atol=1e-5)


def test_least_variance_of_many_names(spark):
    rng = np.random.default_rng(6)
    names = 5000
    days = [d("2020-03-31"), d("2020-06-30"), d("2020-09-30"), d("2020-12-31"), d("2021-03-31"), d("2021-06-30")]
    level = 100 * np.cumprod(1 + rng.normal(0, 0.1, (len(days), names)) + rng.normal(0, 0.1, (len(days), 1)), axis=0)
    rows = [(f"T{i}", day, float(level[t, i])) for t, day in enumerate(days) for i in range(names)]
    prices = spark.createDataFrame(rows, "tic string, datadate date, price double")
    picked = prices.filter(F.col("datadate") == days[-1]).select(F.col("datadate").alias("date"), "tic")
    w = B.min_variance_weights(picked, prices).toPandas().set_index("tic")["weight"]
    assert len(w) == names and abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    r = (level[1:] / level[:-1] - 1) @ w.loc[[f"T{i}" for i in range(names)]].to_numpy()
    assert r.std() < 1e-4  # more names than rows: no variance is left


def test_models_are_fitted_once_and_the_stack_competes(spark, monkeypatch):
    from stratapanel.operators import models as M
    from stratapanel.plans import model_queries as Q

    monkeypatch.setattr(Q, "SIZES", {"trees": 3, "depth": 2, "rounds": 2})
    fits = []
    real = M.fit
    monkeypatch.setattr(M, "fit", lambda *a: fits.append(1) or real(*a))
    sf = "/root/testdata/sf0.001"
    first = Q.bucket_models(spark, sf).collect()
    once = len(fits)
    assert once == 24 * len({r.bucket for r in first})  # three models and nine folds, on two spans
    found = Q.feature_importance(spark, sf).collect()
    stack = Q.stacking(spark, sf).collect()
    assert len(fits) == once and stack and all(r.val_mse > 0 for r in stack)
    assert {r.feature for r in found if r.bucket == "cyclical"} >= {"sector_ASIA", "ret_accel", "revenue"}
    assert "sector_EUROPE" not in {r.feature for r in found if r.bucket == "cyclical"}
    _, models, _ = Q._trained(spark, sf)
    assert {r.model for r in models.collect()} == {"forest", "boosted", "ridge", "stacking"}
    Q._TRAINED.clear()
    assert sorted(Q.bucket_models(spark, sf).collect()) == sorted(first)  # another run says the same


def test_window_ridges_with_missing_values(spark):
    from stratapanel.operators import moments as R

    rng = np.random.default_rng(3)
    days = [x.date() for x in pd.date_range("2018-03-31", periods=9, freq="QE")]
    rows = []
    for t, day in enumerate(days):
        for i in range(20):
            x, z = rng.normal(5, 2, 2)
            rows.append((f"T{i}", day, None if rng.random() < 0.2 else float(x), float(z), None, None if t == 8 else float(x - z)))
    df = spark.createDataFrame(rows, "tic string, datadate date, x double, z double, gone double, y_return double")
    got = R.window_ridges(df, ["x", "z", "gone"], 5, 2).collect()
    assert [r.trade for r in sorted(got)] == days[7:]
    pdf = pd.DataFrame(rows, columns=["tic", "day", "x", "z", "gone", "y"])
    for r in got:
        t = days.index(r.trade)
        train, test = pdf[pdf.day.isin(days[t - 7 : t - 2])], pdf[pdf.day.isin(days[t - 2 : t])]
        med = train[["x", "z"]].median()
        a = train[["x", "z"]].fillna(med)
        m, s = a.mean(), a.std()
        coef = np.linalg.solve(((a - m) / s).T @ ((a - m) / s) + np.eye(2), ((a - m) / s).T @ (train.y - train.y.mean())) / s
        assert np.allclose(r.coefficients, [*coef, 0.0]) and r.rows == 100
        error = test.y - train.y.mean() - (test[["x", "z"]].fillna(med) - m) @ coef.to_numpy()
        assert math.isclose(r.error, float((error**2).mean()), rel_tol=1e-9)
    assert R.window_ridges(df.filter("false"), ["x", "z"], 5, 2).count() == 0


def test_macd_fold_equals_the_recursion(spark):
    rng = np.random.default_rng(9)
    rows = []
    for tic, n in (("A", 300), ("B", 1), ("C", 40)):
        for k in range(n):
            x = None if rng.random() < 0.1 or tic == "A" and k < 3 else float(100 + rng.normal())
            rows.append((tic, d("2020-01-01") + dt.timedelta(days=k), x))
    got = W.macd(spark.createDataFrame(rows, "tic string, date date, close double"), "close").toPandas().sort_values(["tic", "date"])
    pdf = pd.DataFrame(rows, columns=["tic", "date", "x"])
    for tic, own in pdf.groupby("tic"):
        line = own.x.ewm(span=12).mean() - own.x.ewm(span=26).mean()
        mine = got[got.tic == tic]
        assert np.allclose(mine.macd, line, equal_nan=True) and np.allclose(mine.macd_signal, line.ewm(span=9).mean(), equal_nan=True)
    assert "Pandas" not in W.macd(spark.createDataFrame(rows, "tic string, date date, close double"), "close")._jdf.queryExecution().toString()


def test_pairwise_matrices_take_named_series_only(spark):
    rng = random.Random(3)
    levels = {n: [100 * (1 + 0.1 * rng.random()) for _ in range(8)] for n in "abc"}
    day = dt.date(2024, 1, 1)
    rows = [(n, day + dt.timedelta(i), x) for n, xs in levels.items() for i, x in enumerate(xs)]
    series = spark.createDataFrame(rows, "name string, date date, close double")
    returns = {n: [b / a - 1 for a, b in zip(xs, xs[1:])] for n, xs in levels.items()}
    got = {(r.date, r.name_i, r.name_j): r.cov for r in W.rolling_covariance(series, ["c", "a"], 4).collect()}
    assert {(i, j) for _, i, j in got} == {("a", "a"), ("a", "c"), ("c", "c")} and len(got) == 3 * 4
    last = day + dt.timedelta(7)
    assert got[last, "a", "c"] == pytest.approx(statistics.covariance(returns["a"][-4:], returns["c"][-4:]))
    corr = {(r.name_i, r.name_j): r["corr"] for r in W.correlation_matrix(series, ["a", "b"]).collect()}
    assert corr["a", "b"] == pytest.approx(statistics.correlation(returns["a"], returns["b"])) and len(corr) == 3
    for names in ([], [str(i) for i in range(W.MOST_SERIES + 1)]):
        with pytest.raises(ValueError):
            W.correlation_matrix(series, names)


def test_trades_against_a_walk_through_the_days(spark):
    rng = random.Random(11)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(9)]
    close = {(t, d): 50 + rng.random() for t in "abcd" for d in days if rng.random() < 0.85 or d == days[0]}
    held = {
        (s, d): dict.fromkeys(rng.sample("abcd", rng.choice((1, 2, 3))), 0.3)
        for s in ("one", "two") for d in days if (s, d) != ("one", days[0]) and rng.random() < 0.8
    }
    weights = spark.createDataFrame([(s, d, t, x) for (s, d), w in held.items() for t, x in w.items()], "strategy string, date date, tic string, weight double")
    prices = spark.createDataFrame([(t, d, x) for (t, d), x in close.items()], "tic string, date date, close double")

    def change_of(tic, d):
        before = [x for x in days if x < d and (tic, x) in close]
        return close[tic, d] / close[tic, before[-1]] - 1 if before and (tic, d) in close else 0.0

    want = {}
    for s in ("one", "two"):
        for y, d in zip([None, *days], days):
            old, new = held.get((s, y), {}), held.get((s, d), {})
            gross = sum(x * change_of(t, d) for t, x in old.items())
            for t in old.keys() | new.keys():
                drift = old.get(t, 0.0) * (1 + change_of(t, d)) / (1 + gross)
                want[s, d, t] = (gross, new.get(t, 0.0) - drift)
    table = Q.trade_table(weights, prices)
    got = {(r.strategy, r.date, r.tic): (r.gross, r.change) for r in table.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert Q.trade_table(weights.filter("false"), prices).collect() == []


def test_fits_overlap_longest_first():
    import threading

    from stratapanel.operators import models as M

    started, every = [], threading.Barrier(M.FITS_AT_ONCE, timeout=20)

    def job(key):
        def run():
            started.append(key)
            every.wait()  # passes only if all of them are under way together
            return key

        return run

    keys = [("train", m, k) for k in range(4) for m in ("forest", "boosted", "ridge")]
    assert len(keys) == M.FITS_AT_ONCE
    assert M._all_fits({k: job(k) for k in keys}, M.FITS_AT_ONCE) == {k: k for k in keys}
    assert {k[1] for k in started[:4]} == {"boosted"}


def test_forests_keep_row_places(spark):
    from stratapanel.operators import models as M

    assert M.candidate_models(10)["forest"].getCacheNodeIds()


def test_universe_of_some_days(spark):
    calendar = days(spark, "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05")
    chosen = spark.createDataFrame([(d("2024-01-01"), "a"), (d("2024-01-03"), "b")], "trade_date date, tic string")
    some = days(spark, "2024-01-03", "2024-01-05", "2024-02-01")
    got = {(r.date, r.tic) for r in J.daily_universe_expand(chosen, calendar, only=some).collect()}
    assert got == {(d("2024-01-03"), "a"), (d("2024-01-05"), "b")}


def test_signals_are_expanded_to_the_days_that_use_them(spark, monkeypatch):
    from stratapanel.plans import panel as P
    from stratapanel.plans import portfolio_queries as Z

    asked = []

    def expand(signals, calendar, freq, universe=None, before=J.signal_expand_to_daily):
        asked.append({r.date for r in calendar.select("date").collect()})
        return before(signals, calendar, freq, universe)

    monkeypatch.setattr(J, "signal_expand_to_daily", expand)
    sf = "/root/testdata/sf0.001"
    Z.monthly_target_weights(spark, sf)
    Z.step_weights(spark, sf)
    every = {r.date for r in P.calendar(spark, sf).collect()}
    assert asked[0] == {r.date for r in Z._month_events(P.calendar(spark, sf)).filter("kind = 'signal'").collect()}
    assert asked[0] < every and asked[1] < every


def test_held_weights_are_multiplied_after_the_last_exchange(spark):
    rows = [("s", d("2024-01-01"), t, x) for t, x in (("a", 1.0), ("b", 3.0))] + [("s", d("2024-01-03"), "a", -2.0)]
    weights = spark.createDataFrame(rows, "strategy string, date date, tic string, weight double")
    held = Q.weight_ffill_normalise(weights, days(spark, "2024-01-01", "2024-01-02", "2024-01-04"))
    got = {(r.date.day, r.tic): r.weight for r in held.collect()}
    assert got == {(1, "a"): 0.25, (1, "b"): 0.75, (2, "a"): 0.25, (2, "b"): 0.75, (4, "a"): -2.0}
    plan = held._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("explode(_days") < plan.index("Join")


def test_trades_meet_in_one_exchange_by_ticker(spark, monkeypatch):
    plans = []

    def cut(df, name, before=Q.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df, name)

    monkeypatch.setattr(Q, "cut_lineage", cut)
    weights = spark.createDataFrame([("s", d("2024-01-01"), "a", 1.0)], "strategy string, date date, tic string, weight double")
    prices = spark.createDataFrame([("a", d("2024-01-01"), 2.0), ("a", d("2024-01-02"), 3.0)], "tic string, date date, close double")
    got = {(r.date.day, r.gross, r.change) for r in Q.trade_table(weights, prices).collect()}
    assert got == {(1, 0.0, 1.0), (2, 0.5, -1.0)}
    assert plans[0].count("Exchange hashpartitioning(tic") == 1 and "hashpartitioning(strategy" not in plans[0]


def test_nearest_price_without_a_row_for_each_try(spark):
    rng = random.Random(3)
    start = d("2024-01-01")
    close = {(t, k): rng.random() for t in "ab" for k in range(0, 90) if rng.random() < 0.15}
    prices = spark.createDataFrame([(t, start + dt.timedelta(k), x) for (t, k), x in close.items()], "tic string, date date, close double")
    asked = [(t, k) for t in "abc" for k in range(-8, 98)] + [("a", 4), (None, 3), ("a", None)]
    rows = spark.createDataFrame([(t, None if k is None else start + dt.timedelta(k)) for t, k in asked], "tic string, on date")
    found = J.price_nearest_bounded(rows, prices, "on")

    def near(t, k):
        tries = [] if t is None or k is None else [0, *(s * i for i in range(1, 6) for s in (1, -1))]
        return next((close[t, k + o] for o in tries if (t, k + o) in close), None)

    want = sorted(((t, k, near(t, k)) for t, k in asked), key=repr)
    assert sorted(((r.tic, r.on and (r.on - start).days, r.price) for r in found.collect()), key=repr) == want
    assert "explode" not in found._jdf.queryExecution().sparkPlan().toString()


def test_rolling_sharpe_of_long_frames(spark):
    rng = random.Random(5)
    rets = [None] + [rng.gauss(0, 0.01) for _ in range(30)] + [0.1] * 9 + [1e9] + [rng.gauss(0, 0.01) for _ in range(12)]
    rets += [None] + [0.3, float("nan")] + [rng.gauss(0, 0.01) for _ in range(8)]
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for t in ("A", None) for i, x in enumerate(rets)]
    d = W.rolling_sharpe(spark.createDataFrame(rows, "tic string, date date, ret double"), "ret", "sharpe", n=7)
    for tic in ("A", None):
        got = [r["sharpe"] for r in d.filter(F.col("tic").eqNullSafe(F.lit(tic))).orderBy("date").collect()]
        for i, x in enumerate(got):
            frame = rets[max(i - 6, 0) : i + 1]
            if len(frame) < 7 or None in frame:
                assert x is None
            elif len(set(frame)) == 1:
                assert x == 0.0
            elif any(v != v for v in frame):
                assert x != x
            else:
                assert x == pytest.approx(statistics.mean(frame) / statistics.stdev(frame) * math.sqrt(252), rel=1e-9)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"RowFrame, -\d+, currentrow", plan)  # no row looks at n others


def test_window_function_per_ticker(spark):
    nan = float("nan")
    rows = [("A", dt.date(2020, 1, 1 + i), x, i) for i, x in enumerate([1.0, 4.0, None, 2.0, 7.0, nan, 3.0])]
    rows += [("B", dt.date(2020, 1, 1), 5.0, None), (None, dt.date(2020, 1, 2), 1.0, 2**60), (None, dt.date(2020, 1, 3), 9.0, 1)]
    df = spark.createDataFrame(rows, "tic string, date date, x double, place long").repartition(3)
    want = {
        ("A", 1): (None, 0), ("A", 2): (3.0, 1), ("A", 3): (None, 2), ("A", 4): (None, 3), ("A", 5): (5.0, 4), ("A", 6): (0.0, 5),
        ("A", 7): (0.0, 6), ("B", 1): (None, None), (None, 2): (None, 2**60), (None, 3): (8.0, 1),
    }
    for many in (False, True):
        d = U.window_function(df, "x", 2, lambda w: w.max() - w.min(), "spread", many=many)
        assert {(r["tic"], r["date"].day): (r["spread"], r["place"]) for r in d.collect()} == want
        assert d.columns == ["tic", "date", "x", "place", "spread"]


def test_boosted_fits_share_their_jobs_and_are_those_of_mllib(spark, tmp_path, monkeypatch):
    from pyspark.ml import PipelineModel

    from stratapanel.operators import boosting
    from stratapanel.operators import models as M

    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        x, z = (float(v) for v in rng.normal(0, 1, 2))
        rows.append((f"T{i:03}", d("2020-03-31"), x if i % 7 else None, z, float(i % 3), 1.0, x * z + i % 3 + float(rng.normal(0, 0.1))))
    df = M.sized(spark.createDataFrame(rows, "tic string, datadate date, x double, z double, k double, same double, y_return double"))
    features, rounds, depth = ["x", "z", "k", "same"], 12, 3
    parts = [df, df.filter("tic < 'T250'"), df.filter("z > 0"), df.filter("tic < 'T025'")]
    model = M.candidate_models(400, rounds=rounds, boosted_depth=depth)["boosted"]
    own = [M.fit(p, features, model) for p in parts]

    def last_job():
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    group = boosting.Together()
    found = [M.fit(p, features, group.member(model)) for p in parts]
    before = last_job()
    group.train()
    assert last_job() - before <= rounds * depth + 20  # one fit of MLlib takes about as many
    monkeypatch.setattr(boosting, "BLOCK", 60)  # and with several blocks of rows
    more = M._fits_together({i: (p, features, model, None) for i, p in enumerate(parts)})
    for i, p in enumerate(own):
        found[i].write().overwrite().save(str(tmp_path / str(i)))
        want = {r.tic: r.prediction for r in p.transform(df).collect()}
        for got in (PipelineModel.load(str(tmp_path / str(i))), more[i]):
            assert isinstance(got.stages[-1], boosting.BoostedModel)
            assert all(abs(r.prediction - want[r.tic]) < 1e-9 for r in got.transform(df).collect())
            assert np.allclose(got.stages[-1].featureImportances.toArray(), p.stages[-1].featureImportances.toArray())


def test_cuts_have_equal_numbers_of_rows_between():
    from stratapanel.operators.boosting import cuts_of

    assert cuts_of(np.array([1.0, 1.0, 1.0]), 31) == []
    assert cuts_of(np.array([3.0, 1.0, 2.0, 1.0]), 31) == [1.5, 2.5]
    assert cuts_of(np.arange(100.0), 4) == [19.5, 39.5, 59.5, 79.5]


def test_labels_that_are_no_numbers_are_refused(spark):
    from stratapanel.operators import models as M

    rows = [(f"T{i}", d("2020-03-31"), float(i), float("nan") if i == 5 else 1.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "tic string, datadate date, x double, y_return double")
    model = M.candidate_models(30, rounds=2)["boosted"]
    with pytest.raises(Exception, match="finite"):
        M._fits_together({k: (df, ["x"], model, None) for k in (1, 2)})


def test_works_of_several_steps_are_made_together(spark):
    from stratapanel.operators import models as M

    rows = [(f"T{i}", d("2020-03-31"), float(i), 2.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "tic string, datadate date, x double, y_return double").cache()
    job = (df, ["x"], M.candidate_models(30)["ridge"], None)

    def work(steps):
        seen = 0
        for _ in range(steps):
            seen += len((yield {"a": job, "b": job}))
        return seen

    assert M._together([work(n) for n in (0, 1, 2)]) == [0, 2, 4]


def test_cuts_of_a_sample_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    from stratapanel.operators import boosting
    from stratapanel.operators import models as M

    rng = np.random.default_rng(14)
    rows = [(f"T{i:03}", d("2020-03-31"), float(x), float(x * x + z)) for i, (x, z) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "tic string, datadate date, x double, y_return double").coalesce(1)
    model = M.candidate_models(300, rounds=3)["boosted"]
    monkeypatch.setattr(boosting, "SAMPLE", 60)
    both = M._fits_together({i: (df.orderBy(o).coalesce(1), ["x"], model, None) for i, o in enumerate((F.asc("tic"), F.desc("tic")))})
    a, b = ({r.tic: r.prediction for r in both[i].transform(df).collect()} for i in (0, 1))
    assert all(abs(a[t] - b[t]) < 1e-9 for t in a)
