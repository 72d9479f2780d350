"""Model training as MLlib jobs: roles, candidate models, stacking, ensembles, rolling windows.

Training sets hold one row per ticker and quarter. Every fit is distributed; the loops run over
short lists (buckets, model names, quarters). Callers pass a written table, since each fit reads
it again. Works on buckets or quarters ask for the fits they need, which are made together: boosted
trees of all of them in common jobs (``boosting``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Mapping, Sequence

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.operators.boosting import Together
from stratapanel.sources.scratch import cut_lineage

#: Buckets or quarters that are worked on at a time, and fits for each of them. A fit is a chain of short jobs of a few
#: tasks each, so many must be under way to keep a cluster busy.
AT_ONCE, FITS_AT_ONCE = 8, 12
#: Rows of a training table in one partition.
ROWS_IN_PARTITION = 50_000
KEYS = ("tic", "datadate")


def split_val_quarters(df: DataFrame, cutoff: str, n: int = 3) -> DataFrame:
    """Add ``role``: the last n labelled quarters up to the cutoff validate, earlier ones train,
    later ones are inferred; unlabelled rows before the cutoff have no role."""
    cut = F.lit(cutoff).cast("date")
    d = F.col("datadate")
    known = F.col("y_return").isNotNull() & (d <= cut)
    # Quarters are a short list.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("datadate"))
    quarters = df.filter(known).select("datadate").distinct().withColumn("_q", F.row_number().over(w))
    role = F.when(d > cut, "infer").when(known & (F.col("_q") <= n), "val").when(known, "train")
    return df.join(quarters, "datadate", "left").withColumn("role", role).drop("_q")


def candidate_models(
    rows: int, trees: int = 200, depth: int = 8, rounds: int = 200, boosted_depth: int = 3, seed: int = 42
) -> dict:
    """Forest, boosted trees and ridge over standardised features.

    The sizes are those of the models this stands in for; smaller ones are the caller's choice. The
    ridge penalty is 1 on the summed squared error, hence 1 / rows here.
    """
    common = {"featuresCol": "scaled", "labelCol": "y_return"}
    return {
        # a row's place in each tree is kept, not found anew from the root for each level; the trees are the same
        "forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, **common),
        "boosted": GBTRegressor(maxIter=rounds, maxDepth=boosted_depth, stepSize=0.1, seed=seed, **common),
        "ridge": LinearRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, **common),
    }


def sized(df: DataFrame) -> DataFrame:
    """Training rows in as few partitions as their number asks for, in key order: fits are many short jobs.

    The order makes row samples, and so the fitted trees, the same on every run.
    """
    return df.repartition(df.count() // ROWS_IN_PARTITION + 1, *KEYS).sortWithinPartitions(*KEYS).cache()


def fit(train: DataFrame, features: Sequence[str], model, flags: str | None = None) -> PipelineModel:
    """Impute with the medians of the training rows, standardise, fit. No row is left out.

    ``flags`` names a vector column of further features, as ``with_flags`` makes it.
    """
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, flags] if flags else filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        model,
    ]
    return Pipeline(stages=stages).fit(train)


def with_flags(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Add ``<column>_flags``: 0/1 for every value that the rows have; their names in order.

    Values that no row has get no flag, so none is 0 throughout; a null has no flag set.
    """
    made = Pipeline(stages=[
        StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol=f"{column}_index", outputCol=f"{column}_flags", dropLast=True),  # the last is "unknown"
    ]).fit(df)
    return made.transform(df).drop(f"{column}_index"), [f"{column}_{x}" for x in made.stages[0].labels]


def known_features(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value among the training rows; the others have no median."""
    seen = train.agg(*(F.count(f).alias(f) for f in features)).first()
    return [f for f in features if seen[f]]


def predict(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).select(*KEYS, "y_return", F.lit(name).alias("model"), F.col("prediction").alias("pred"))


def mse(preds: DataFrame) -> float | None:
    e = F.col("y_return") - F.col("pred")
    return preds.agg(F.avg(e * e)).first()[0]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a fit takes: rows, features, model, column of flags.
Job = tuple[DataFrame, Sequence[str], object, str | None]
#: A work that yields the fits it needs by name and is sent the fitted models; what it returns is its result.
Work = Generator[Mapping[object, Job], dict, object]


def _all_fits(jobs: Mapping, at_once: int) -> dict:
    """Fitted models of independent fits, a few at a time: each is a chain of short jobs."""
    order = sorted(jobs, key=lambda k: "boosted" not in k)  # the longest chains first
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(order, pool.map(lambda k: jobs[k](), order), strict=True))


def _fits_together(jobs: Mapping[object, Job]) -> dict:
    """Fitted models of independent fits, many at a time; boosted trees of all of them grow in common jobs."""
    group = Together()
    boosted = {k for k, job in jobs.items() if isinstance(job[2], GBTRegressor)}
    boosted = boosted if len(boosted) > 1 else set()

    def run(rows: DataFrame, features: Sequence[str], model, flags: str | None) -> Callable[[], PipelineModel]:
        return lambda: fit(rows, features, model, flags)

    prepared = {(k,): run(*job[:2], group.member(job[2]), job[3]) for k, job in jobs.items() if k in boosted}
    others = {(k,): run(*job) for k, job in jobs.items() if k not in boosted}
    with ThreadPoolExecutor(1) as beside:
        waiting = beside.submit(_all_fits, others, AT_ONCE * FITS_AT_ONCE)
        ready = _all_fits(prepared, AT_ONCE * FITS_AT_ONCE)
        group.train()
        return {k: model for (k,), model in (ready | waiting.result()).items()}


def _together(works: Sequence[Work]) -> list:
    """Results of works that do not depend on each other; the fits that they need at a time are made together."""
    results: dict[int, object] = {}

    def go_on(i: int, fitted: dict | None) -> Mapping[object, Job] | None:
        try:
            return works[i].send(fitted)
        except StopIteration as end:
            results[i] = end.value
            return None

    wanted: dict[int, Mapping] = dict.fromkeys(range(len(works)))
    sent: dict[int, dict | None] = dict(wanted)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while wanted:
            asked = dict(zip(wanted, pool.map(lambda i: go_on(i, sent[i]), wanted), strict=True))
            wanted = {i: jobs for i, jobs in asked.items() if jobs is not None}
            fitted = _fits_together({(i, k): job for i, jobs in wanted.items() for k, job in jobs.items()})
            sent = {i: {k: fitted[i, k] for k in jobs} for i, jobs in wanted.items()}
    return [results[i] for i in range(len(works))]


def _wide(parts: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    return _union(parts).groupBy(*KEYS).pivot("model", list(names)).agg(F.first("pred"))


def _stack(oof: Sequence[DataFrame], labelled: DataFrame, names: Sequence[str]) -> PipelineModel:
    """Ridge over out-of-fold predictions of the base models."""
    top = _wide(oof, names).join(labelled.select(*KEYS, "y_return"), list(KEYS))
    ridge = candidate_models(1)["ridge"].setRegParam(1.0 / max(top.count(), 1))
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="scaled"), ridge]).fit(top)


def run_models(
    df: DataFrame, features: Sequence[str], cutoff: str, folder: str, val_quarters: int = 3, min_train: int = 20,
    bucket: str = "all", sizes_of: Mapping[str, int] | None = None, flags: str | None = None, folds: int = 3, top: int = 3,
) -> tuple[DataFrame, list] | None:
    """Fit, validate, refit on train and validation rows, predict the rest; models are saved below ``folder``.

    The ``top`` models by validation error are also stacked: a ridge over their out-of-fold predictions (a row's
    fold comes from a hash of its key). The stack has an error of its own and is a candidate like the others.
    Returns (long predictions, model rows) or None without enough data. ``sizes_of`` sets the sizes of
    ``candidate_models``, ``flags`` a column whose values become 0/1 features.
    """
    return _together([_models_work(df, features, cutoff, folder, val_quarters, min_train, bucket, sizes_of, flags, folds, top)])[0]


def _models_work(
    df: DataFrame, features: Sequence[str], cutoff: str, folder: str, val_quarters: int = 3, min_train: int = 20,
    bucket: str = "all", sizes_of: Mapping[str, int] | None = None, flags: str | None = None, folds: int = 3, top: int = 3,
) -> Work:
    labels: list[str] = []
    if flags:
        df, labels = with_flags(df, flags)
    d = sized(split_val_quarters(df, cutoff, val_quarters).withColumn("_fold", F.pmod(F.xxhash64(*KEYS), F.lit(folds))))
    sizes = {r["role"]: r["count"] for r in d.groupBy("role").count().collect()}
    if sizes.get("train", 0) < min_train or not sizes.get("infer", 0):
        d.unpersist()
        return None
    vector = f"{flags}_flags" if flags else None
    n_val = sizes.get("val", 0)
    spans = {"train": F.col("role") == "train", "full": F.col("role").isin("train", "val")}
    rows_of = {"train": sizes["train"], "full": sizes["train"] + n_val}
    features = known_features(d.filter(spans["train"]), features)
    val, infer = d.filter(F.col("role") == "val"), d.filter(F.col("role") == "infer")

    def job(span: str, name: str, fold: int | None = None) -> Job:
        rows = d.filter(spans[span] if fold is None else spans[span] & (F.col("_fold") != fold))
        return rows, features, candidate_models(rows_of[span], **(sizes_of or {}))[name], vector

    names = list(candidate_models(1))
    def of_folds(models: Sequence[str]) -> dict:
        return {(span, m, k): job(span, m, k) for span in spans for m in models for k in range(folds)}

    # only where some models do not get into the stack do the fits of folds wait for the errors
    first = {(span, m, None): job(span, m) for span in spans for m in names}
    all_in = top >= len(names)
    fitted = yield first | (of_folds(names) if all_in else {})
    errors = {m: mse(predict(fitted["train", m, None], val, m)) for m in names}
    bases = sorted(names, key=lambda m: math.inf if errors[m] is None else errors[m])[:top]
    if not all_in:
        fitted |= yield of_folds(bases)
    stacks = {
        span: _stack(
            [predict(fitted[span, m, k], d.filter(rows & (F.col("_fold") == k)), m) for m in bases for k in range(folds)],
            d.filter(rows), bases,
        ) for span, rows in spans.items()
    }

    def stacked(span: str, rows: DataFrame) -> DataFrame:
        wide = _wide([predict(fitted[span, m, None], rows, m) for m in bases], bases)
        return predict(stacks[span], wide.join(rows.select(*KEYS, "y_return"), list(KEYS)), "stacking")

    errors["stacking"] = mse(stacked("train", val)) if n_val else None
    rows = [(bucket, m, None if e is None else round(e, 6), sizes["train"], n_val, sizes["infer"]) for m, e in errors.items()]
    parts = [predict(fitted["full", m, None], infer, m) for m in names] + [stacked("full", infer)]
    # the models of a row stand together in order, so sums over them are the same on every run
    placed = _union(parts).withColumn("bucket", F.lit(bucket)).repartition(*KEYS).sortWithinPartitions(*KEYS, "model")
    preds = cut_lineage(placed, "predictions")
    for m in names:
        fitted["full", m, None].write().overwrite().save(f"{folder}/{bucket}/{m}")
    stacks["full"].write().overwrite().save(f"{folder}/{bucket}/stacking")
    df.sparkSession.createDataFrame(
        [(bucket, i, f) for i, f in enumerate([*features, *labels])], "bucket string, place int, feature string"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{bucket}/features")
    d.unpersist()
    return preds, rows


MODEL_SCHEMA = "bucket string, model string, val_mse double, train_size long, val_size long, infer_size long"
IMPORTANCE_SCHEMA = "bucket string, model string, is_best boolean, feature string, importance double"


def importances(fitted: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, or absolute coefficients scaled to sum to 1."""
    m = fitted.stages[-1]
    if hasattr(m, "featureImportances"):
        return list(zip(features, (float(x) for x in m.featureImportances.toArray()), strict=True))
    size = [abs(float(x)) for x in m.coefficients]
    total = sum(size) or 1.0
    return list(zip(features, (x / total for x in size), strict=True))


def bucket_models(
    df: DataFrame, features: Sequence[str], buckets: Sequence[str], cutoff: str, folder: str, **kw
) -> tuple[DataFrame, DataFrame]:
    """``run_models`` for each bucket: (predictions, models) as tables; the fitted models lie below ``folder``."""
    # buckets do not depend on each other
    works = [_models_work(df.filter(F.col("bucket") == b).drop("bucket"), features, cutoff, folder, bucket=b, **kw) for b in buckets]
    runs = [r for r in _together(works) if r]
    if not runs:
        raise ValueError("no bucket has enough rows")
    models = df.sparkSession.createDataFrame([x for r in runs for x in r[1]], MODEL_SCHEMA)
    return _union([r[0] for r in runs]), cut_lineage(models, "models")


def saved_importances(models: DataFrame, folder: str) -> DataFrame:
    """Importances of the models that ``bucket_models`` saved; nothing is fitted again.

    Where the stack is the best model, the forest's importances stand for it as well.
    """
    spark = models.sparkSession
    best = {r["bucket"]: r["model"] for r in _best(models).collect()}
    rows = []
    for bucket, name in best.items():  # a short list: each is a fitted model of its own
        table = spark.read.parquet(f"{folder}/{bucket}/features").orderBy("place").collect()
        for m in candidate_models(1):
            found = importances(PipelineModel.load(f"{folder}/{bucket}/{m}"), [r["feature"] for r in table])
            rows += [(bucket, m, m == name, f, v) for f, v in found]
            if name == "stacking" and m == "forest":
                rows += [(bucket, "stacking", True, f, v) for f, v in found]
    return spark.createDataFrame(rows, IMPORTANCE_SCHEMA)


def _best(models: DataFrame) -> DataFrame:
    """Each bucket's model with the least validation error; one without an error only if there is no other."""
    order = F.struct(F.col("val_mse").isNull(), "val_mse", "model")
    return models.groupBy("bucket").agg(F.min_by("model", order).alias("model"))


def rank_importance(imp: DataFrame) -> DataFrame:
    w = Window.partitionBy("bucket", "model").orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w).cast("long"))


def best_predictions(preds: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions of each bucket's model with the least validation error."""
    return preds.join(_best(models), ["bucket", "model"])


def inverse_mse_ensemble(preds: DataFrame, models: DataFrame) -> DataFrame:
    """Mean of all models' predictions weighted by 1 / rounded error; no or zero error weighs 0."""
    e = F.round("val_mse", 6)
    w = models.select("bucket", "model", F.when(e > 0, 1 / e).otherwise(0.0).alias("_w"))
    d = preds.join(w, ["bucket", "model"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    return d.groupBy("bucket", *KEYS).agg(F.try_divide(F.sum(F.col("_w") * F.col("pred")), F.sum("_w")).alias("ensemble"))


def rolling_train_single(
    df: DataFrame, features: Sequence[str], trade: str, test_quarters: int = 4, train_quarters: int | None = None,
    names: Sequence[str] = ("ridge", "forest", "boosted"), sizes_of: Mapping[str, int] | None = None,
    quarters: Sequence[str] | None = None, also: Mapping[str, tuple[float, DataFrame]] | None = None,
) -> DataFrame | None:
    """Train before the last test quarters, validate on them, predict the trade quarter.

    Windows count the quarters that there are: the ``test_quarters`` before the trade quarter test, the
    ``train_quarters`` before those (all, if None) train. ``quarters`` is the list of the table's
    quarter ends, read if not given. Returns the predictions of the model with the least error (on the test
    rows, else the training rows) with its name, its error and the errors of all candidates, or None
    without enough rows. ``also`` brings candidates that are fitted already: error and predictions by name.
    """
    return _together([_rolling_work(df, features, trade, test_quarters, train_quarters, names, sizes_of, quarters, also)])[0]


def _rolling_work(
    df: DataFrame, features: Sequence[str], trade: str, test_quarters: int = 4, train_quarters: int | None = None,
    names: Sequence[str] = ("ridge", "forest", "boosted"), sizes_of: Mapping[str, int] | None = None,
    quarters: Sequence[str] | None = None, also: Mapping[str, tuple[float, DataFrame]] | None = None,
) -> Work:
    if quarters is None:
        quarters = [str(r[0]) for r in df.select("datadate").distinct().orderBy("datadate").collect()]
    before = [q for q in quarters if q < trade]
    cut = max(len(before) - test_quarters, 0)
    begin = 0 if train_quarters is None else max(cut - train_quarters, 0)
    if trade not in quarters or not before[begin:cut]:
        return None

    def among(qs: Sequence[str]):
        return F.col("datadate").between(F.lit(qs[0]).cast("date"), F.lit(qs[-1]).cast("date"))

    d = sized(df.filter(among([before[begin], trade])))
    known = d.filter(F.col("y_return").isNotNull())
    train = known.filter(among(before[begin:cut]))
    test = known.filter(among(before[cut:])) if before[cut:] else known.filter("false")
    now = d.filter(F.col("datadate") == F.lit(trade).cast("date"))
    n = train.count()
    if n < 10 or now.isEmpty():
        d.unpersist()
        return None
    features = known_features(train, features)
    models = candidate_models(n, **(sizes_of or {}))
    fitted = yield {m: (train, features, models[m], None) for m in names}
    errors = {m: e for m, (e, _) in (also or {}).items()}
    for m in names:
        on_test = mse(predict(fitted[m], test, m))
        errors[m] = mse(predict(fitted[m], train, m)) if on_test is None else on_test
    best = min(errors, key=lambda m: math.inf if errors[m] is None else errors[m])
    every = F.create_map(*(F.lit(x) for m in sorted(errors) for x in (m, errors[m])))
    if best in fitted:
        out = predict(fitted[best], now, best)
    else:
        ready = also[best][1].filter(F.col("datadate") == F.lit(trade).cast("date"))
        out = ready.select(*KEYS, "y_return", F.lit(best).alias("model"), "pred")
    out = out.withColumns({"model_mse": F.lit(errors[best]), "model_errors": every})
    out = cut_lineage(out, "rolling")
    d.unpersist()
    return out


def rolling_train_all(
    df: DataFrame, features: Sequence[str], trades: Sequence[str], train_quarters: int = 16, test_quarters: int = 4,
    names: Sequence[str] = ("ridge", "forest", "boosted"), **kw
) -> DataFrame:
    """``rolling_train_single`` for every trade quarter on its own window of quarters.

    All ridges come from one aggregate (``moments.window_ridges``); the trees of all quarters, which do not depend on
    each other, are fitted together.
    """
    return rolling_train_each({"all": df}, features, trades, train_quarters, test_quarters, names, **kw)["all"]


def rolling_train_each(
    tables: Mapping[str, DataFrame], features: Sequence[str], trades: Sequence[str], train_quarters: int = 16,
    test_quarters: int = 4, names: Sequence[str] = ("ridge", "forest", "boosted"), **kw
) -> dict[str, DataFrame]:
    """``rolling_train_all`` of several tables, each with models of its own; their trees are fitted together too."""
    from stratapanel.operators import moments

    def works_of(df: DataFrame) -> list[Work]:
        quarters = [str(r[0]) for r in df.select("datadate").distinct().orderBy("datadate").collect()]
        ridges: dict = {}
        if "ridge" in names:
            table = cut_lineage(moments.window_ridges(df, features, train_quarters, test_quarters), "ridges")
            ready = cut_lineage(moments.ridge_predictions(df, table, features), "ridge-predictions")
            ridges = {str(r["trade"]): {"ridge": (r["error"], ready)} for r in table.select("trade", "error").collect()}

        def one(t: str) -> Work:
            also = ridges.get(t)
            own = [m for m in names if not also or m not in also]
            return _rolling_work(df, features, t, test_quarters, train_quarters, own, quarters=quarters, also=also, **kw)

        return [one(t) for t in trades]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        works = dict(zip(tables, pool.map(works_of, tables.values()), strict=True))
    results = iter(_together([w for own in works.values() for w in own]))
    parts = {name: [p for p in (next(results) for _ in own) if p is not None] for name, own in works.items()}
    if not all(parts.values()):
        raise ValueError("no quarter has enough rows")
    return {name: _union(own) for name, own in parts.items()}


def rolling_date_windows(dates: DataFrame, train_days: int, test_days: int) -> DataFrame:
    """Train span [t - train, t - test) and test span [t - test, t) of each trade date."""
    t = F.col("date")
    return dates.select(
        t.alias("trade_date"), F.date_sub(t, train_days).alias("train_start"), F.date_sub(t, test_days).alias("test_start")
    )


def compare_model_returns(windows: DataFrame, returns: DataFrame) -> DataFrame:
    """Compounded return of each model in each test span and the best one.

    ``returns(name, date, ret)`` are daily series. Test spans may overlap; each names the months it
    touches, so days and spans meet by month and not by a range.
    """
    first, last = F.trunc("test_start", "month"), F.trunc("trade_date", "month")
    spans = windows.select("test_start", "trade_date").distinct().withColumn(
        "_m", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    )
    d = returns.filter(F.col("ret").isNotNull()).withColumn("_m", F.trunc("date", "month")).join(spans, "_m")
    d = d.filter((F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("trade_date")))
    g = d.groupBy("trade_date", "name").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    w = Window.partitionBy("trade_date").orderBy(F.desc("ret"), "name")
    return g.withColumn("is_best", F.row_number().over(w) == 1)


WeightsContract = Callable[[DataFrame, Mapping], DataFrame]


def strategy_weights(
    preds: DataFrame, q: float = 0.75, sector: bool = False, method: str = "equal", prices: DataFrame | None = None,
    gap_prices: DataFrame | None = None, execution: str | None = None,
) -> DataFrame:
    """Predictions to capped weights: same-day adjustment, quantile selection, allocation, risk caps.

    ``preds(tic, datadate, sector, pred)``; per-sector selection with ``sector``. With ``execution`` (a day) and
    ``gap_prices(tic, date, close)`` the move of the last trading day is taken off each prediction first.
    """
    from stratapanel.operators import joins as J
    from stratapanel.operators import portfolio as B
    from stratapanel.operators import ranking as X

    if execution is not None:
        moved = J.same_day_gap_adjust(preds, gap_prices, execution)
        preds = cut_lineage(moved.withColumn("pred", F.col("adjusted")).drop("realized", "adjusted"), "adjusted")
    keys = ["datadate", "sector"] if sector else ["datadate"]
    s = X.quantile_select(preds, q, keys, positive=not sector).withColumn("date", F.col("datadate"))
    w = B.allocate_weights(s, method, prices)
    return B.risk_caps(w.select("date", "tic", "sector", "pred", "weight"))
