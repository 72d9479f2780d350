"""Cross-section ranking, quantile selection and exception rules.

A date's cross-section may hold any number of tickers, so ranks and quantiles over it use the
spread helpers of ``order_stats``; top-k selections use ``row_number() <= k``, which Spark cuts
per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions.order_stats import grouped_quantiles, grouped_rank
from stratapanel.operators import features as W
from stratapanel.sources.scratch import cut_lineage

# Bucket order, and the blend of unified and bucket ranks per bucket.
BUCKETS = ("growth_tech", "cyclical", "real_assets", "defensive")
BUCKET_ALPHA = {"growth_tech": 0.0, "cyclical": 0.7, "real_assets": 1.0, "defensive": 1.0}
ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str) -> DataFrame:
    """First n rows per key in an order, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= n)


def asset_scores(returns: DataFrame, groups: DataFrame, weeks: int = 12, max_z: float = 20.0) -> DataFrame:
    """Score of each asset against its group at every week.

    ``returns(tic, sector, date, ret)``, ``groups(sector, date, ret)``. The z-score is that of the
    last residual in the window; a window with an unknown residual scores 0.
    """
    g = groups.select("sector", "date", F.col("ret").alias("_g"))
    d = returns.join(g, ["sector", "date"]).withColumn("residual", F.col("ret") - F.col("_g"))
    frame = R.last_rows(R.by("tic"), weeks)
    x = F.col("residual")
    rows = F.count("*").over(frame)
    xs = F.collect_list(x).over(frame)
    z = R.let(xs, lambda a: F.when((F.size(a) == rows) & (F.size(a) > 0), W.mad_score(a, x)))
    clipped = F.least(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(-max_z)), F.lit(max_z))
    valid = rows >= 0.8 * weeks
    return d.withColumns(
        {
            "is_valid": valid,
            "zscore": F.when(valid, clipped).otherwise(0.0),
            "residual_momentum": F.when(
                valid, F.coalesce(F.product(1 + x).over(frame), F.lit(1.0)) - 1
            ).otherwise(0.0),
        }
    ).drop("_g")


def intra_group_rank(scores: DataFrame) -> DataFrame:
    """Place of each valid asset in its group and week, by falling z-score then ticker."""
    valid = scores.filter("is_valid")
    return grouped_rank(valid, ["date", "sector"], "zscore", method="first", tie_break=["tic"])


def top_n_per_group(scores: DataFrame, n: int = 3, active: DataFrame | None = None) -> DataFrame:
    """First n valid assets per group and week, for active groups when given."""
    d = scores.filter("is_valid")
    if active is not None:
        d = d.join(active.select("date", "sector"), ["date", "sector"], "left_semi")
    return top_rows(d, ["date", "sector"], [F.desc("zscore"), "tic"], n, "rank")


def rank_groups_select_active(
    strength: DataFrame, metric: str = "information_ratio", trend_filter: bool = True, max_active: int = 2
) -> DataFrame:
    """Valid groups ranked per week; the first ``max_active`` with positive excess are active."""
    w = Window.partitionBy("date").orderBy(F.desc(metric), "sector")
    d = strength.filter("is_valid").withColumn("rank", F.row_number().over(w).cast("long"))
    passes = (F.col("excess_return") > 0) if trend_filter else F.lit(True)
    before = F.sum(passes.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("is_active", passes & (before <= max_active))


def quantile_select(preds: DataFrame, q: float = 0.75, keys: Sequence[str] = ("datadate",), positive: bool = True) -> DataFrame:
    """Predictions at or above the quantile of their cross-section.

    With ``positive`` the threshold is at least 0 and only positive predictions stay; without it
    (the per-sector rule) the quantile alone decides.
    """
    keys = list(keys)
    t = grouped_quantiles(preds, keys, "pred", {"threshold": q}).drop("n")
    if positive:
        t = t.withColumn("threshold", F.greatest("threshold", F.lit(0.0)))
    d = preds.join(t, keys).filter(F.col("pred") >= F.col("threshold"))
    return d.filter(F.col("pred") > 0) if positive else d


def bucket_select_strict_relaxed(
    preds: DataFrame, n: int = 7, q: float = 0.75, keys: Sequence[str] = ("datadate", "bucket")
) -> DataFrame:
    """The n best of each bucket, marked by whether n of them pass the strict rule.

    Strict rows (at or above the quantile and positive) are the head of the same order, so the
    selection itself is one top-n in both modes.
    """
    keys = list(keys)
    t = grouped_quantiles(preds, keys, "pred", {"threshold": q}).withColumnRenamed("n", "candidates")
    strict = (F.col("pred") >= F.col("threshold")) & (F.col("pred") > 0)
    marks = preds.join(t, keys).groupBy(*keys, "threshold", "candidates").agg(F.count_if(strict).alias("strict"))
    best = top_rows(preds, keys, [F.desc("pred"), "tic"], n, "bucket_rank")
    mode = F.when(F.col("strict") >= n, "strict_quantile").otherwise("relaxed_topk")
    return best.join(marks, keys).withColumn("mode", mode).drop("strict")


def bucket_selection_summary(selected: DataFrame, dates: DataFrame, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """Candidates, selected and mode per date and bucket; an empty bucket says so."""
    s = selected.groupBy("datadate", "bucket").agg(
        F.first("candidates").alias("candidates"), F.count("*").alias("selected"), F.first("mode").alias("mode")
    )
    every = dates.select("datadate", F.explode(F.array(*(F.lit(b) for b in buckets))).alias("bucket"))
    return every.join(s, ["datadate", "bucket"], "left").select(
        "datadate", "bucket", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("mode", F.lit("no_candidates")).alias("mode"),
    )


def rank_within_bucket(preds: DataFrame, value: str, keys: Sequence[str], rank: str, pct: str | None = None) -> DataFrame:
    """Falling average rank cut to an integer; ``pct`` adds the rising average rank over n."""
    d = grouped_rank(preds, keys, value, rank="_avg", size="_n")
    d = d.withColumn(rank, F.floor("_avg").cast("long"))
    if pct:
        # Rising and falling average ranks of n values add up to n + 1.
        d = d.withColumn(pct, (F.col("_n") + 1 - F.col("_avg")) / F.col("_n"))
    return d.drop("_avg", "_n")


def blend_percentiles(preds: DataFrame, keys: Sequence[str] = ("bucket", "datadate")) -> DataFrame:
    """Percentile ranks of bucket and unified predictions inside each bucket and date."""
    d = rank_within_bucket(preds, "bucket_pred", keys, "_r", "bucket_pctile").drop("_r")
    # a rank reads its table twice: written once, the next rank does not repeat what came before
    d = rank_within_bucket(cut_lineage(d, "ranked"), "unified_pred", keys, "_r", "unified_pctile").drop("_r")
    return cut_lineage(d, "percentiles")


def dual_ensemble(preds: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Blended score and rank for every alpha (one row per alpha)."""
    d = blend_percentiles(preds)
    d = d.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))
    a = F.col("alpha")
    d = d.withColumn("score", a * F.col("unified_pctile") + (1 - a) * F.col("bucket_pctile"))
    return rank_within_bucket(d, "score", ["alpha", "bucket", "datadate"], "rank")


def mixed_alpha(preds: DataFrame, bucket_alpha: Mapping[str, float] = BUCKET_ALPHA) -> DataFrame:
    """Blend with each bucket's own alpha, and a half-half blend to compare with."""
    pairs = [F.lit(x) for kv in bucket_alpha.items() for x in kv]
    d = blend_percentiles(preds).withColumn("alpha", F.try_element_at(F.create_map(*pairs), F.col("bucket")))
    a = F.col("alpha")
    d = d.withColumns(
        {
            "mixed_score": a * F.col("unified_pctile") + (1 - a) * F.col("bucket_pctile"),
            "uniform_score": 0.5 * F.col("unified_pctile") + 0.5 * F.col("bucket_pctile"),
        }
    )
    keys = ["bucket", "datadate"]
    d = cut_lineage(rank_within_bucket(d, "mixed_score", keys, "rank_mixed"), "ranked")
    return rank_within_bucket(d, "uniform_score", keys, "rank_uniform")


def alpha_sensitivity(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Mean realised return of the top n per bucket and date, for each alpha, against all rows."""
    proxy = ranked.groupBy("alpha").agg(F.avg("y_return").alias("proxy"))
    top = top_rows(ranked.filter(F.col("rank").isNotNull()), ["alpha", "bucket", "datadate"], ["rank", "tic"], n, "_rn")
    per = top.groupBy("alpha", "bucket", "datadate").agg(F.avg("y_return").alias("m"))
    out = per.groupBy("alpha").agg(F.avg("m").alias("top_avg"))
    return out.join(proxy, "alpha").withColumn("excess", F.col("top_avg") - F.col("proxy"))


def latest_prediction(preds: DataFrame, date: str = "datadate") -> DataFrame:
    """Newest row of each ticker."""
    rest = [c for c in preds.columns if c != "tic"]
    return preds.groupBy("tic").agg(F.max_by(F.struct(*rest), date).alias("r")).select("tic", "r.*")


def exception_mk(z: DataFrame, threshold: float = 2.5, k: int = 4, m: int = 2) -> DataFrame:
    """How many of the last k scores are above the threshold, their dates, and whether m are."""
    frame = R.last_rows(R.by("tic"), k)
    hit = F.col("z") > threshold
    enough = F.count("*").over(frame) == k
    n = F.when(enough, F.sum(F.coalesce(hit.cast("long"), F.lit(0))).over(frame)).otherwise(0)
    dates = F.when(enough, F.collect_list(F.when(hit, F.col("date"))).over(frame)).otherwise(
        F.array().cast("array<date>")
    )
    return z.withColumns({"trigger_count": n, "trigger_dates": dates}).withColumn(
        "mk", F.col("trigger_count") >= m
    )


def exception_strong_signal(
    z: DataFrame, bench: DataFrame, threshold: float = 3.5, multiple: float = 1.5, prices: int = 12, positive: bool = True
) -> DataFrame:
    """High score with a return over the last ``prices`` prices above a multiple of the benchmark's.

    ``z(tic, date, close, z)``, ``bench(date, close)``.
    """
    bw = Window.partitionBy(F.lit(1)).orderBy("date")
    b = bench.select("date", (F.col("close") / F.lag("close", prices - 1).over(bw) - 1).alias("bench_ret"))
    d = z.withColumn("asset_ret", R.change(F.col("close"), R.by("tic"), prices - 1)).join(b, "date", "left")
    a, br = F.col("asset_ret"), F.col("bench_ret")
    need = multiple * br
    ok = (F.col("z") >= threshold) & (a > need)
    if positive:
        ok = ok & (a > 0)
    reason = (
        F.when(F.coalesce(F.col("z") < threshold, F.lit(True)), "score")
        .when(a.isNull() | br.isNull(), "data")
        .when((a <= 0) & F.lit(positive), "negative")
        .when(a <= need, "benchmark")
        .otherwise("qualified")
    )
    return d.withColumns({"strong": F.coalesce(ok, F.lit(False)), "reason": reason})


def exception_candidates(z: DataFrame, bench: DataFrame, pool: DataFrame | None = None, **rules) -> DataFrame:
    """All candidates with both rules at every week, qualified ones in falling score order."""
    if pool is not None:
        z = z.join(pool.select("tic").distinct(), "tic", "left_semi")
    mk = exception_mk(z, rules.get("threshold", 2.5), rules.get("k", 4), rules.get("m", 2))
    d = exception_strong_signal(mk, bench, rules.get("strong", 3.5), rules.get("multiple", 1.5), rules.get("prices", 12))
    d = cut_lineage(d.withColumn("qualifies", F.col("mk") | F.col("strong")), "candidates")
    ranked = grouped_rank(
        d.withColumn("_z", F.when(F.col("qualifies"), F.col("z"))), ["date"], "_z", method="first", tie_break=["tic"], rank="place"
    )
    return ranked.drop("_z")


def quantile_buckets(preds: DataFrame, date: str = "datadate") -> DataFrame:
    """Quarter of its date's predictions each row falls in, and the lowest and highest 30 percent."""
    qs = {"q25": 0.25, "q30": 0.3, "q50": 0.5, "q70": 0.7, "q75": 0.75}
    t = grouped_quantiles(preds, [date], "pred", qs).drop("n")
    p = F.col("pred")
    quarter = F.when(p <= F.col("q25"), 1).when(p <= F.col("q50"), 2).when(p <= F.col("q75"), 3).otherwise(4)
    return preds.join(t, date).withColumns(
        {"quarter": quarter.cast("long"), "low_30": p <= F.col("q30"), "high_70": p >= F.col("q70")}
    ).drop(*qs)


def bucket_top5_tracking(preds: DataFrame, returns: DataFrame, bench: DataFrame, n: int = 5) -> DataFrame:
    """Daily growth of the n best names per bucket, held over the quarter after their date.

    ``preds(tic, datadate, bucket, pred)``, ``returns(tic, date, ret)``, ``bench(date, ret)``. Names
    weigh the same in a bucket and buckets the same in the portfolio. The holding quarter is part
    of the join key, so picks meet only their own days.
    """
    picks = top_rows(preds, ["datadate", "bucket"], [F.desc("pred"), "tic"], n, "pick")
    picks = picks.select("tic", "datadate", "bucket", F.date_add("datadate", 1).alias("_q"))
    r = returns.filter(F.col("ret").isNotNull()).withColumn("_q", F.trunc("date", "quarter"))
    held = picks.join(r, ["tic", "_q"])
    by_bucket = held.groupBy("datadate", "bucket", "date").agg(F.avg("ret").alias("ret"))
    total = by_bucket.groupBy("datadate", "date").agg(F.avg("ret").alias("ret")).withColumn("bucket", F.lit("portfolio"))
    b = bench.filter(F.col("ret").isNotNull()).select("date", F.col("ret").alias("_b"))
    d = by_bucket.unionByName(total).join(b, "date")
    frame = R.upto(R.by("datadate", "bucket"))
    return d.select(
        "datadate", "bucket", "date",
        (F.product(1 + F.col("ret")).over(frame) - 1).alias("cumulative"),
        (F.product(1 + F.col("_b")).over(frame) - 1).alias("bench_cumulative"),
    ).withColumn("alpha", F.col("cumulative") - F.col("bench_cumulative"))
