"""Weekly rotation: from raw trades to weights for every week in one plan.

The decision week is a key column throughout, so a whole history of decisions is computed at
once. Ticker windows come first (one shuffle by ticker), then group and date aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.operators import calendar as C
from stratapanel.operators import metrics as A
from stratapanel.operators import portfolio as B
from stratapanel.operators import ranking as X
from stratapanel.operators import regime as G
from stratapanel.plans import panel as P
from stratapanel.plans.registry import view
from stratapanel.sources.scratch import cut_lineage



def week_ends(spark: SparkSession, sf: str) -> DataFrame:
    return C.week_end_dates(P.calendar(spark, sf))


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The smoothed daily panel, written once for all tables of a run that are derived from it."""
    return cut_lineage(P.smooth(spark, sf), "daily")


def weekly(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """Weekly calm closes and returns per ticker, with the ticker's sector."""
    d = daily_panel(spark, sf) if daily is None else daily
    m = A.week_map(d, week_ends(spark, sf))
    w = d.join(m, "date").groupBy("tic", "week_end").agg(F.max_by("close", "date").alias("close"))
    w = w.withColumnRenamed("week_end", "date")
    t = Window.partitionBy("tic").orderBy("date")
    w = w.withColumn("ret", F.col("close") / F.lag("close").over(t) - 1)
    return w.join(P.sectors(spark, sf), "tic")


def index_daily(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """Daily index level, a second index (one sector) and a volatility index in percent.

    A row for each day, written once: everything that hangs on the index reads these few rows.
    """
    daily = daily_panel(spark, sf) if daily is None else daily
    b = P.bench(spark, sf, daily).withColumn("_r", F.col("close") / F.lag("close").over(R.whole()) - 1)
    vol = F.when(
        F.count("_r").over(R.whole().rowsBetween(-19, 0)) == 20,
        F.round(F.stddev_samp("_r").over(R.whole().rowsBetween(-19, 0)) * 100, 9),
    )
    second = (
        daily.join(P.sectors(spark, sf), "tic").filter(F.col("sector") == "ASIA")
        .groupBy("date").agg((F.sum(F.floor(F.col("close") * 100)) / F.count("*") / 100).alias("qqq"))
    )
    d = b.select("date", F.col("close").alias("spx"), vol.alias("vix")).join(second, "date", "left")
    filled = F.last("qqq", ignorenulls=True).over(R.whole().rowsBetween(Window.unboundedPreceding, 0))
    return cut_lineage(d.withColumn("qqq", filled).filter(F.col("vix").isNotNull()), "index")


def index_weekly(spark: SparkSession, sf: str, index: DataFrame | None = None) -> DataFrame:
    d = index_daily(spark, sf) if index is None else index
    m = A.week_map(d, week_ends(spark, sf))
    return d.join(m, "date").groupBy(F.col("week_end").alias("_w")).agg(
        F.max_by("spx", "date").alias("spx"), F.max_by("vix", "date").alias("vix")
    ).withColumnRenamed("_w", "date")


def group_returns(w: DataFrame) -> DataFrame:
    return A.group_equal_weight_return(w, "sector")


def bench_weekly(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    d = P.bench(spark, sf, daily)
    m = A.week_map(d, week_ends(spark, sf))
    b = d.join(m, "date").groupBy(F.col("week_end").alias("_w")).agg(F.max_by("close", "date").alias("close"))
    b = b.withColumnRenamed("_w", "date")
    return b.withColumn("ret", F.col("close") / F.lag("close").over(R.whole()) - 1)


def regime_weekly(spark: SparkSession, sf: str, index: DataFrame | None = None) -> DataFrame:
    return G.regime_mapping(G.slow_regime(index_weekly(spark, sf, index)))


def decisions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables of one weekly decision run: regime, strength, scores, weights.

    The daily panel is built from raw trades once; the weekly table, the benchmark and the index
    come from it, and the regime from the index.
    """
    daily = daily_panel(spark, sf)
    w = cut_lineage(weekly(spark, sf, daily), "weekly")
    g = cut_lineage(group_returns(w), "groups")
    bench = cut_lineage(bench_weekly(spark, sf, daily), "bench")
    index = index_daily(spark, sf, daily)
    strength = cut_lineage(X.rank_groups_select_active(A.group_strength(g, bench)), "strength")
    scores = cut_lineage(X.asset_scores(w, g), "scores")
    active = strength.filter("is_active")
    top = X.top_n_per_group(scores, 3, active)
    regime = cut_lineage(regime_weekly(spark, sf, index), "regime")
    return {
        "strength": strength, "scores": scores, "top": top, "budget": B.risk_budget(regime),
        "bench": bench, "index": index, "regime": regime,
    }


def weekly_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every week: date, sector, tic, weight, cash, regime state."""
    d = decisions(spark, sf)
    return B.portfolio_weights(d["top"], d["budget"])


view("week_ends_prev", "SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM week_ends")
view("week_map", """
SELECT p.date, w.date AS week_end FROM (SELECT DISTINCT date FROM smooth) p ASOF JOIN week_ends_prev w ON p.date <= w.date
WHERE p.date > coalesce(w.prev + 1, w.date - 7)""")
view("weekly", """
SELECT tic, date, close, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret, sector FROM (
  SELECT tic, week_end AS date, max_by(close, date) AS close FROM smooth JOIN week_map USING (date) GROUP BY 1, 2) x JOIN sectors USING (tic)""")
view("group_weekly", "SELECT sector, date, avg(ret) AS ret FROM weekly GROUP BY 1, 2")
view("bench_weekly", """
SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM (
  SELECT week_end AS date, max_by(close, date) AS close FROM bench JOIN week_map USING (date) GROUP BY 1) x""")
view("index_daily", """
SELECT date, spx, vix, last_value(qqq IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS qqq FROM (
  SELECT date, close AS spx, CASE WHEN count(r) OVER w = 20 THEN round(stddev_samp(r) OVER w * 100, 9) END AS vix FROM (
    SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench) b
  WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) v
LEFT JOIN (SELECT date, CAST(sum(CAST(floor(close * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS qqq FROM smooth JOIN sectors USING (tic) WHERE sector = 'ASIA' GROUP BY 1) q USING (date)
QUALIFY vix IS NOT NULL""")
view("index_weekly", """
SELECT week_end AS date, max_by(spx, date) AS spx, max_by(vix, date) AS vix FROM index_daily JOIN week_map USING (date) GROUP BY 1""")
