"""Cleaning, imputation, clipping, sector maps and payload projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapanel.functions.order_stats import grouped_quantiles

# Sector label to model bucket.
SECTOR_TO_BUCKET = {
    "information technology": "growth_tech",
    "technology": "growth_tech",
    "communication services": "growth_tech",
    "consumer discretionary": "cyclical",
    "consumer cyclical": "cyclical",
    "financials": "cyclical",
    "financial services": "cyclical",
    "industrials": "cyclical",
    "energy": "real_assets",
    "materials": "real_assets",
    "basic materials": "real_assets",
    "real estate": "real_assets",
    "health care": "defensive",
    "healthcare": "defensive",
    "consumer staples": "defensive",
    "consumer defensive": "defensive",
    "utilities": "defensive",
}

# Provider ratio field to factor column.
RATIO_FIELDS = {
    "grossProfitMargin": "gross_margin",
    "operatingProfitMargin": "operating_margin",
    "ebitdaMargin": "ebitda_margin",
    "pretaxProfitMargin": "pretax_margin",
    "effectiveTaxRate": "effective_tax_rate",
    "ebtPerEbit": "ebt_per_ebit",
    "assetTurnover": "asset_turnover",
    "fixedAssetTurnover": "fixed_asset_turnover",
    "inventoryTurnover": "inventory_turnover",
    "payablesTurnover": "payables_turnover",
    "workingCapitalTurnoverRatio": "wc_turnover",
    "debtToAssetsRatio": "debt_to_assets",
    "debtToCapitalRatio": "debt_to_capital",
    "longTermDebtToCapitalRatio": "lt_debt_to_capital",
    "interestCoverageRatio": "interest_coverage",
    "debtServiceCoverageRatio": "debt_service_coverage",
    "debtToMarketCap": "debt_to_mktcap",
    "freeCashFlowPerShare": "fcf_per_share",
    "operatingCashFlowPerShare": "ocf_per_share",
    "cashPerShare": "cash_per_share",
    "capexPerShare": "capex_per_share",
    "freeCashFlowOperatingCashFlowRatio": "fcf_to_ocf",
    "operatingCashFlowRatio": "ocf_ratio",
    "operatingCashFlowSalesRatio": "ocf_to_sales",
    "operatingCashFlowCoverageRatio": "ocf_coverage",
    "shortTermOperatingCashFlowCoverageRatio": "st_ocf_coverage",
    "capitalExpenditureCoverageRatio": "capex_coverage",
    "revenuePerShare": "revenue_per_share",
    "tangibleBookValuePerShare": "tangible_bvps",
    "interestDebtPerShare": "interest_debt_per_share",
    "priceToEarningsGrowthRatio": "peg",
    "priceToFreeCashFlowRatio": "price_to_fcf",
    "priceToOperatingCashFlowRatio": "price_to_ocf",
    "enterpriseValueMultiple": "ev_multiple",
    "dividendPayoutRatio": "dividend_payout",
    "dividendYield": "dividend_yield",
    "dividendPaidAndCapexCoverageRatio": "div_capex_coverage",
    "solvencyRatio": "solvency_ratio",
}

# Sentiment labels in the order they are looked for in free text.
SENTIMENTS = ("positive", "neutral", "negative")


def clean_prices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per (gvkey, datadate) by ``order``; positive price and factor; adjusted prices."""
    rest = [c for c in df.columns if c not in ("gvkey", "datadate")]
    first = df.groupBy("gvkey", "datadate").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select("gvkey", "datadate", "r.*")
    kept = first.filter((F.col("prccd") > 0) & (F.col("ajexdi") > 0))
    adj = kept.withColumn("adj_close", F.col("prccd") / F.col("ajexdi"))
    for raw, name in (("prcod", "adj_open"), ("prchd", "adj_high"), ("prcld", "adj_low")):
        value = F.col(raw) / F.col("ajexdi") if raw in rest else F.col("adj_close")
        adj = adj.withColumn(name, value)
    return adj


def drop_sparse_columns(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Drop columns whose share of nulls is above the limit (one pass, one row to the driver)."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if shares[c] is not None and shares[c] > limit))


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(*keys, f"stack({len(cols)}, {pairs}) as (_col, _val)")


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles of several columns at once: keys and one ``{col}_{prob}`` column each."""
    keys = list(keys)
    q = grouped_quantiles(_long(df, keys, cols), [*keys, "_col"], "_val", probs)
    picks = [
        F.max(F.when(F.col("_col") == c, F.col(p))).alias(f"{c}_{p}") for c in cols for p in probs
    ]
    return (q.groupBy(*keys) if keys else q).agg(*picks)


def sector_median_impute(df: DataFrame, cols: Sequence[str], sector: str = "sector") -> DataFrame:
    """Null to the median of its sector; a sector without any value stays null."""
    med = column_quantiles(df, cols, {"med": 0.5}, [sector])
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}_med")) for c in cols}
    return df.join(med, sector, "left").withColumns(filled).drop(*(f"{c}_med" for c in cols))


def _one_row(df: DataFrame) -> Column:
    """A one-row table as one struct value usable in any expression."""
    return df.select(F.struct(*df.columns)).scalar()


def global_median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null to the median of the whole column (infinities counted), then infinities to 0."""
    d = df.withColumn("_m", _one_row(column_quantiles(df, cols, {"med": 0.5})))
    inf = F.lit(float("inf"))
    out = {}
    for c in cols:
        x = F.coalesce(F.col(c), F.col(f"_m.{c}_med"))
        out[c] = F.when(F.abs(x) == inf, 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    return d.withColumns(out).drop("_m")


def winsorize_quantile(
    df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Clip each column at its own quantiles over the whole table; nulls stay null."""
    d = df.withColumn("_q", _one_row(column_quantiles(df, cols, {"lo": low, "hi": high})))
    out = {
        c: F.when(
            F.col(c).isNotNull(),
            F.least(F.greatest(F.col(c), F.col(f"_q.{c}_lo")), F.col(f"_q.{c}_hi")),
        )
        for c in cols
    }
    return d.withColumns(out).drop("_q")


# Columns that are never model features.
NOT_FEATURES = (
    "gvkey", "tic", "gsector", "datadate", "y_return", "prccd", "ajexdi", "adj_close", "adj_close_q",
)


def supervised_dataset(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric features (infinities and nulls to the median, constant columns dropped) plus y.

    Rows without a label are kept: they are the ones to predict.
    """
    skip = {*NOT_FEATURES, *exclude}
    cols = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    inf = F.lit(float("inf"))
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < inf, F.col(c).cast("double")) for c in cols}
    d = df.withColumns(finite)
    spread = d.agg(*(F.struct(F.min(c), F.max(c)).alias(c) for c in cols)).first()
    # A column is constant once nulls take the median exactly when its known values are constant.
    kept = [c for c in cols if spread[c][0] is not None and spread[c][0] != spread[c][1]]
    m = d.withColumn("_m", _one_row(column_quantiles(d, kept, {"med": 0.5})))
    filled = {c: F.coalesce(F.col(c), F.col(f"_m.{c}_med")) for c in kept}
    keys = [c for c in ("tic", "datadate") if c in df.columns]
    return m.withColumns(filled).select(*keys, *kept, "y_return")


def sector_one_hot(df: DataFrame, sector: str, values: Sequence[str] | None = None) -> DataFrame:
    """0/1 column ``sector_*`` for every sector present (the list is short and read once)."""
    if values is None:
        values = sorted(r[0] for r in df.select(sector).distinct().dropna().collect())
    flags = {
        f"sector_{v.replace(' ', '_')}": F.coalesce(F.col(sector) == v, F.lit(False)).cast("int")
        for v in values
    }
    return df.withColumns(flags)


def sector_to_bucket(sector: Column, default: str | None = None, squeeze: bool = False) -> Column:
    """Bucket of a sector label. ``squeeze`` trims and collapses blanks first."""
    key = F.lower(sector)
    if squeeze:
        key = F.regexp_replace(F.trim(key), r"\s+", " ")
    pairs = [F.lit(x) for kv in SECTOR_TO_BUCKET.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, F.lit(default)) if default else found


def universe_filter(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose ticker is in the universe table."""
    return df.join(universe.select("tic").distinct(), "tic", "left_semi")


def ticker_normalise(tickers: Column, old: str = ".", new: str = "-") -> Column:
    """Comma list to an array of trimmed tickers with another share-class separator."""
    return F.transform(F.split(tickers, ","), lambda t: F.translate(F.trim(t), old, new))


def zscore_normalise_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation per column over the whole table; zero variance gives 0."""
    inf = F.lit(float("inf"))
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < inf, F.col(c).cast("double")) for c in cols}
    d = df.withColumns(finite)
    stats = d.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in cols),
        *(F.stddev_samp(c).alias(f"{c}_std") for c in cols),
    )
    d = d.withColumn("_s", _one_row(stats))
    out = {}
    for c in cols:
        std = F.col(f"_s.{c}_std")
        z = F.try_divide(F.col(c) - F.col(f"_s.{c}_mean"), std)
        out[c] = F.when(std > 0, z).otherwise(0.0)
    return d.withColumns(out).drop("_s")


def full_coverage_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of dates on which every ticker of the table is present."""
    size = df.agg(F.count_distinct("tic")).scalar()
    good = df.groupBy(date).agg(F.count_distinct("tic").alias("n")).filter(F.col("n") == size)
    return df.join(good.select(date), date, "left_semi")


def sufficient_history(df: DataFrame, as_of: str, min_rows: int) -> DataFrame:
    """Tickers with too few rows up to a date, with their row count."""
    n = F.count_if(F.col("date") <= F.lit(as_of).cast("date"))
    return df.groupBy("tic").agg(n.alias("rows")).filter(F.col("rows") < min_rows)


def date_format_coalesce(text: Column) -> Column:
    """Date from ISO text, else compact digits, else a few common spellings; else null."""
    formats = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("date")


def _num(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return F.col(name).try_cast("double")


def _set(c: Column) -> Column:
    """Null for 0: a zero counts as not given in an either-or chain."""
    return F.nullif(c, F.lit(0.0))


def fundamental_factors(
    income: DataFrame, balance: DataFrame, cash: DataFrame, ratios: DataFrame, prices: DataFrame
) -> DataFrame:
    """Factors per (tic, quarter): the provider's ratio first, else computed from statements.

    ``prices`` carries the quarter's ``price`` per (tic, quarter).
    """
    keys = ["tic", "quarter"]
    d = income
    for side in (balance, cash, ratios):
        d = d.join(side, keys, "full")
    d = d.join(prices, keys, "left")
    n = lambda name: _num(d, name)  # noqa: E731 - short local alias
    shares = F.coalesce(
        _set(n("commonStockSharesOutstanding")), _set(n("weightedAverageShsOutDil")), n("weightedAverageShsOut")
    )
    equity = F.coalesce(n("totalStockholdersEquity"), F.lit(0.0))
    net = n("netIncome")
    eps = F.coalesce(n("eps"), F.try_divide(net, _set(shares)))
    bps = F.try_divide(equity, _set(shares))
    dividends = F.coalesce(_set(n("commonDividendsPaid")), n("dividendsPaid"))
    dps = F.coalesce(n("dividendPerShare"), F.try_divide(F.abs(dividends), _set(shares)))
    ca, cl = _set(n("totalCurrentAssets")), _set(n("totalCurrentLiabilities"))
    inventory = F.coalesce(_set(n("inventory")), n("inventoryAndOtherCurrentAssets"))
    liabilities, assets = _set(n("totalLiabilities")), _set(n("totalAssets"))
    debt_to_equity = F.coalesce(_set(n("debtEquityRatio")), n("debtToEquity"))
    price = F.col("price")
    out = {
        "EPS": eps,
        "BPS": bps,
        "DPS": dps,
        "cur_ratio": F.coalesce(n("currentRatio"), F.try_divide(ca, cl)),
        "quick_ratio": F.coalesce(n("quickRatio"), F.try_divide(ca - inventory, cl)),
        "cash_ratio": F.coalesce(
            n("cashRatio"), F.try_divide(_set(n("cashAndShortTermInvestments")), cl)
        ),
        "acc_rec_turnover": F.coalesce(_set(n("receivablesTurnover")), n("accountsReceivableTurnover")),
        "debt_ratio": F.coalesce(n("debtRatio"), F.try_divide(liabilities, assets)),
        "debt_to_equity": F.coalesce(debt_to_equity, F.try_divide(liabilities, _set(equity))),
        "pe": F.coalesce(n("priceEarningsRatio"), F.try_divide(price, _set(eps))),
        "ps": n("priceToSalesRatio"),
        "pb": F.coalesce(n("priceToBookRatio"), F.try_divide(price, _set(bps))),
        "roe": F.try_divide(net, _set(equity)),
        "net_income_ratio": F.coalesce(n("netProfitMargin"), n("netIncomeRatio")),
    }
    return d.select(*keys, *(c.alias(k) for k, c in out.items()))


def ratio_field_projection(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Provider ratio fields under factor names; text that is no number becomes null."""
    return df.select(*keys, *(_num(df, theirs).alias(ours) for theirs, ours in RATIO_FIELDS.items()))


def sentiment_parse(text: Column) -> tuple[Column, Column]:
    """Sentiment and confidence of a model answer.

    A JSON object with a known label wins; else the first label word that occurs in the text.
    """
    js = F.from_json(
        text,
        "sentiment string, label string, confidence string, score string",
        {"mode": "PERMISSIVE"},
    )

    def given(name: str) -> Column:
        return F.nullif(js[name], F.lit(""))

    label = F.lower(F.coalesce(given("sentiment"), given("label")))
    known = F.coalesce(label.isin(*SENTIMENTS), F.lit(False))
    low = F.lower(text)
    word = F.coalesce(*(F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in SENTIMENTS))

    def number(name: str) -> Column:
        return js[name].try_cast("double")

    conf = F.when(
        F.coalesce(number("confidence") != 0, js["confidence"].isNotNull()), number("confidence")
    ).otherwise(number("score"))
    return F.when(known, label).otherwise(word), F.when(known, conf)


def missing_sentiment_rows(df: DataFrame) -> DataFrame:
    """Articles without a sentiment that have a title or a body."""
    s = F.col("sentiment")
    rows = df.filter(s.isNull() | (F.trim(s) == ""))
    title = F.trim(F.coalesce("title", F.lit("")))
    body = F.trim(F.coalesce("body", F.lit("")))
    rows = rows.filter((title != "") | (body != ""))
    return rows.withColumn("body", body)
