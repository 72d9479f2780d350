"""Streaming queries: each processes all available input through the stream engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import regime as G
from stratapanel.plans import panel as P
from stratapanel.plans import rotation as T
from stratapanel.plans.portfolio_queries import _STOPS, positions
from stratapanel.plans.registry import ORACLES, query
from stratapanel.plans.source_queries import news
from stratapanel.sources import scratch
from stratapanel.streaming import jobs


def _as_stream(df, name, files=4, one_by_one=False):
    """Write a table as files and read it as a stream; ``one_by_one`` makes a micro-batch of each file."""
    spark = df.sparkSession
    path = scratch.new_path(spark, name)
    df.repartition(files).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(path)


def _thirds(df, time):
    """A table in three parts, in the order of a time or date column."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    edges = [low + (high - low) * i / 3 for i in (1, 2)] if low is not None else []
    place = sum(((F.col(time) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return [df.filter(place == i) for i in range(3)]


def _event_quotes(spark, sf):
    e = P.table(spark, sf, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), F.col("user_id")).alias("tic"), F.col("value").alias("price"))


def _quotes(spark, sf):
    schema = P.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), F.col("user_id")).alias("tic"), F.col("value").alias("price"))


@query("stream_quote_bars", """
WITH b AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, 'U' || user_id AS tic, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS quotes FROM events GROUP BY 1, 2)
SELECT * FROM b WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_quote_bars(spark, sf):
    bars = jobs.run_to_files(jobs.quote_bars(_quotes(spark, sf)), "bars")
    return bars.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding_bars", """
WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events),
b AS (SELECT CAST(date_trunc('day', ts) - to_days(k) AS TIMESTAMP) AS start, 'U' || user_id AS tic, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS quotes FROM e GROUP BY 1, 2)
SELECT * FROM b WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sliding_bars(spark, sf):
    parts = _thirds(_event_quotes(spark, sf), "ts")
    bars = jobs.parts_to_files(parts, "sliding-bars", lambda stream: jobs.quote_bars(stream, "2 days", slide="1 day"))
    return bars.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_quote_sessions", """
WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 8 HOUR, true) AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
b AS (SELECT min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", 'U' || user_id AS tic, count(*) AS quotes, max(value) AS high FROM s GROUP BY user_id, n)
SELECT * FROM b WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_quote_sessions(spark, sf):
    parts = _thirds(_event_quotes(spark, sf), "ts")
    rows = jobs.parts_to_files(parts, "sessions", lambda stream: jobs.quote_sessions(stream, "8 hours"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _out_of_order(df, *keys):
    """Three parts by a date that is up to five days off, so that rows of a key cross the borders."""
    off = df.withColumn("_off", F.date_add("date", F.pmod(F.xxhash64(*keys, "date"), F.lit(6)).cast("int")))
    return [p.drop("_off") for p in _thirds(off, "_off")]


@query("stream_stop_loss", _STOPS + """SELECT b.tic, b.entry_date, b.date, kind, b.date + 21 AS cooldown_until FROM sg JOIN br b USING (tic, entry_date, rn)
WHERE b.date < (SELECT max(date) FROM positions) - 7""")
def stream_stop_loss(spark, sf):
    p = scratch.cut_lineage(positions(spark, sf).select("tic", "entry_date", "entry_price", "date", "close"), "positions")
    return jobs.parts_to_files(_out_of_order(p, "tic"), "stops", lambda stream: jobs.stop_loss_stream(stream, idle_days=400))


@query("stream_fast_risk_off", ORACLES["fast_overlay_state"].replace(
    "SELECT params, st.date, is_active, days_remaining, x.date AS trigger_date, reason FROM st LEFT JOIN nxt x ON x.rn = st.start WHERE st.rn > 0",
    "SELECT 'bench' AS \"index\", date, is_active, days_remaining FROM st WHERE rn > 0 AND params = 'base' AND date < (SELECT max(date) FROM shocks) - 7"))
def stream_fast_risk_off(spark, sf):
    s = G.price_vol_shock(T.index_daily(spark, sf)).select(F.lit("bench").alias("index"), "date", "spx", "trigger")
    parts = _out_of_order(scratch.cut_lineage(s, "shocks"), "index")
    return jobs.parts_to_files(parts, "overlay", jobs.fast_risk_off_stream)


@query("stream_incremental_upsert", """
WITH e AS (SELECT min(date) AS low, max(date) - min(date) AS days FROM trades)
SELECT tic, date, arg_max(p, k) + CASE WHEN date < low + CAST(days // 2 AS INT) THEN 0 WHEN date < low + CAST(3 * days // 4 AS INT) THEN 1000 ELSE 2000 END AS close, first, last, fetched
FROM trades JOIN (SELECT tic, min(date) AS first, max(date) AS last, count(*) AS fetched FROM trades GROUP BY 1) USING (tic), e
GROUP BY tic, date, first, last, fetched, low, days""")
def stream_incremental_upsert(spark, sf):
    """Three fetches whose date ranges overlap; the later ones quote other prices, which logged ranges must not take."""
    t = scratch.cut_lineage(P.trades(spark, sf).select("tic", "date", F.col("p").alias("close"), "k"), "trades")
    low, days = t.agg(F.min("date"), F.datediff(F.max("date"), F.min("date"))).first()
    quarter, half, late = (F.date_add(F.lit(low), n) for n in (days // 4, days // 2, 3 * days // 4))
    day, close = F.col("date"), F.col("close")
    parts = [
        t.filter(day < half),
        t.filter((day >= quarter) & (day < late)).withColumn("close", close + 1000),
        t.filter(day >= half).withColumn("close", close + 2000),
    ]
    rows, log, check = (scratch.new_path(spark, f"upsert-{n}") for n in ("rows", "log", "check"))
    jobs.run_parts(parts, "fetches", lambda stream: jobs.incremental_upsert(stream, ["tic", "date"], "k", rows, log, check))
    spans = spark.read.parquet(log).groupBy("tic").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum("rows").alias("fetched"))
    return jobs.resolve_upserts(spark, rows, ["tic", "date"], "k").drop("k").join(spans, "tic")


@query("stream_news", """
WITH e AS (SELECT min(published_datetime) AS low, max(published_datetime) - min(published_datetime) AS days FROM news),
c AS (SELECT ticker, published_datetime AS ts, title, doc_id, CASE WHEN published_datetime < low + days / 3 THEN 0 WHEN published_datetime < low + days * 2 / 3 THEN 1 ELSE 2 END AS part FROM news, e),
m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM c WHERE part < 2)
SELECT DISTINCT ticker, ts AS published_datetime, title FROM c, m WHERE NOT (part = 0 AND doc_id % 10 = 0 AND ts <= mark)""")
def stream_news(spark, sf):
    """Articles that are sent again in the next parts, and some that are first sent in the last one, too late."""
    n = news(spark, sf).select("ticker", F.col("published_datetime").cast("timestamp").alias("published_datetime"), "title", "doc_id")
    first, second, third = _thirds(scratch.cut_lineage(n, "news"), "published_datetime")
    held = F.col("doc_id") % 10 == 0
    parts = [p.drop("doc_id") for p in (first.filter(~held), second.unionByName(first.filter(~held)), third.unionByName(first).unionByName(second))]
    rows = jobs.parts_to_files(parts, "news", lambda stream: jobs.news_stream(stream, stream.columns))
    return rows.withColumn("published_datetime", F.col("published_datetime").cast("timestamp_ntz"))


@query("stream_universe_events", ORACLES["set_difference"])
def stream_universe_events(spark, sf):
    m = scratch.cut_lineage(P.membership(spark, sf).withColumnRenamed("snap_date", "date"), "members")
    every = Window.orderBy("date")  # a row for each snapshot
    dates = scratch.cut_lineage(m.select("date").distinct().withColumn("next", F.lead("date").over(every)), "snapshots")
    return jobs.universe_event_stream(_as_stream(m, "member-stream", one_by_one=True), dates, "universe-events")
