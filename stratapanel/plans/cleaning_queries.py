"""Cleaning, imputation and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import cleaning as K
from stratapanel.plans import panel as P
from stratapanel.plans.registry import cut, qcut, query, view
from stratapanel.plans.source_queries import news, raw_quotes
from stratapanel.sources import scratch


@query("clean_prices", "SELECT gvkey, datadate, prccd, ajexdi, adj_close, adj_open, adj_high, adj_low FROM clean_quotes")
def clean_prices(spark, sf):
    c = K.clean_prices(raw_quotes(spark, sf), ["k", "quantity"])
    return c.select("gvkey", "datadate", "prccd", "ajexdi", "adj_close", "adj_open", "adj_high", "adj_low")


@query("drop_sparse_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 4 THEN o_totalprice END AS some FROM orders""")
def drop_sparse_columns(spark, sf):
    o = P.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 >= 4, F.col("o_totalprice")).alias("some"),
        F.when(F.col("o_orderkey") % 10 >= 6, F.col("o_totalprice")).alias("few"),
    )
    return K.drop_sparse_columns(o)


@query("sector_median_impute", """
WITH h AS (SELECT tic, datadate, sector, CASE WHEN n % 5 <> 0 THEN price END AS price, CASE WHEN sector <> 'AFRICA' AND n % 7 <> 0 THEN revenue END AS revenue FROM predictions)
SELECT tic, datadate, """ + qcut("coalesce(price, median(price) OVER (PARTITION BY sector))", 4) + " AS price, "
+ qcut("coalesce(revenue, median(revenue) OVER (PARTITION BY sector))", 4) + " AS revenue FROM h")
def sector_median_impute(spark, sf):
    p = P.predictions(spark, sf).select(
        "tic", "datadate", "sector", F.when(F.col("n") % 5 != 0, F.col("price")).alias("price"),
        F.when((F.col("sector") != "AFRICA") & (F.col("n") % 7 != 0), F.col("revenue")).alias("revenue"),
    )
    f = K.sector_median_impute(scratch.cut_lineage(p, "predictions"), ["price", "revenue"])
    return f.select("tic", "datadate", cut(F.col("price"), 4).alias("price"), cut(F.col("revenue"), 4).alias("revenue"))


view("holey_lines", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 AND l_discount > 0.08::DOUBLE THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS f1,
       CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS f2 FROM lineitem""")


@query("global_median_impute", """
SELECT l_orderkey, l_linenumber, CASE WHEN isinf(g1) THEN 0 ELSE g1 END AS f1, """ + qcut("g2", 4) + """ AS f2
FROM (SELECT l_orderkey, l_linenumber, coalesce(f1, (SELECT median(f1) FROM holey_lines)) AS g1,
             coalesce(f2, (SELECT median(f2) FROM holey_lines)) AS g2 FROM holey_lines)""")
def global_median_impute(spark, sf):
    li = P.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, None)
        .when((F.col("l_linenumber") == 5) & (F.col("l_discount") > 0.08), F.lit(float("inf")))
        .otherwise(F.col("l_discount")).alias("f1"),
        F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("f2"),
    )
    g = K.global_median_impute(li, ["f1", "f2"])
    return g.select("l_orderkey", "l_linenumber", "f1", cut(F.col("f2"), 4).alias("f2"))


@query("supervised_dataset", """
WITH h AS (SELECT tic, datadate, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE revenue END AS revenue,
           CASE WHEN n % 3 <> 0 THEN CAST(n AS DOUBLE) END AS n, shares, y_return FROM predictions),
f AS (SELECT *, CASE WHEN isinf(revenue) THEN NULL ELSE revenue END AS r FROM h)
SELECT tic, datadate, """ + qcut("coalesce(r, (SELECT median(r) FROM f))", 4) + " AS revenue, "
+ qcut("coalesce(n, (SELECT median(n) FROM f))", 4) + " AS n, shares, " + qcut("y_return") + " AS y_return FROM f")
def supervised_dataset(spark, sf):
    p = P.predictions(spark, sf).select(
        "tic", "datadate", F.col("sector").alias("gsector"),
        F.when(F.col("n") % 5 == 0, None).when(F.col("n") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("revenue")).alias("revenue"),
        F.when(F.col("n") % 3 != 0, F.col("n")).alias("n"), "shares", F.lit(7).alias("constant"),
        F.col("price").alias("adj_close_q"), "y_return",
    )
    d = K.supervised_dataset(scratch.cut_lineage(p, "dataset"))
    return d.select("tic", "datadate", cut(F.col("revenue"), 4).alias("revenue"), cut(F.col("n"), 4).alias("n"),
                    *[c for c in d.columns if c not in ("tic", "datadate", "revenue", "n", "y_return")],
                    cut(F.col("y_return")).alias("y_return"))


view("day_returns", """
SELECT tic, date, close, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret, volume FROM prices""")


def day_returns(spark, sf):
    from stratapanel.operators import features as W

    return P.prices(spark, sf).select("tic", "date", "close", W.simple_return(F.col("close")).alias("ret"), "volume")


@query("winsorize_quantile", """
WITH q AS (SELECT quantile_cont(ret, 0.01) AS rl, quantile_cont(ret, 0.99) AS rh, quantile_cont(volume, 0.01) AS vl, quantile_cont(volume, 0.99) AS vh FROM day_returns)
SELECT tic, date, """ + qcut("CASE WHEN ret IS NOT NULL THEN least(greatest(ret, rl), rh) END") + " AS ret, "
+ qcut("least(greatest(volume, vl), vh)") + " AS volume FROM day_returns, q")
def winsorize_quantile(spark, sf):
    r = scratch.cut_lineage(day_returns(spark, sf).select("tic", "date", "ret", "volume"), "returns")
    w = K.winsorize_quantile(r, ["ret", "volume"])
    return w.select("tic", "date", cut(F.col("ret")).alias("ret"), cut(F.col("volume")).alias("volume"))


@query("sector_one_hot", """
SELECT tic, datadate, """ + ", ".join(
    f"CAST(sector = '{r}' AS INTEGER) AS \"sector_{r.replace(' ', '_')}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
) + " FROM predictions")
def sector_one_hot(spark, sf):
    return K.sector_one_hot(P.predictions(spark, sf).select("tic", "datadate", "sector"), "sector").drop("sector")


# Sector labels standing in for the regions of the given tables; one has stray blanks, one is unknown.
_LABELS = {"AFRICA": "Information Technology", "AMERICA": "Energy", "ASIA": "Financials", "EUROPE": "  Health   Care ", "MIDDLE EAST": "Space Mining"}
_LABEL_SQL = "CASE sector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END"
view("buckets", """
SELECT tic, CASE sector WHEN 'AFRICA' THEN 'growth_tech' WHEN 'AMERICA' THEN 'real_assets' WHEN 'ASIA' THEN 'cyclical' ELSE 'defensive' END AS bucket FROM sectors""")


def sector_labels(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    return P.sectors(spark, sf).withColumn("label", m[F.col("sector")])


def buckets(spark, sf):
    return sector_labels(spark, sf).select("tic", K.sector_to_bucket(F.col("label"), "defensive", True).alias("bucket"))


@query("sector_to_bucket", """
SELECT tic, date, CASE sector WHEN 'AFRICA' THEN 'growth_tech' WHEN 'AMERICA' THEN 'real_assets' WHEN 'ASIA' THEN 'cyclical' END AS ranked,
       bucket AS classified FROM prices JOIN sectors USING (tic) JOIN buckets USING (tic)""")
def sector_to_bucket(spark, sf):
    s = sector_labels(spark, sf).select(
        "tic", K.sector_to_bucket(F.col("label")).alias("ranked"), K.sector_to_bucket(F.col("label"), "defensive", True).alias("classified")
    )
    return P.prices(spark, sf).select("tic", "date").join(s, "tic")


@query("universe_filter", "SELECT tic, date, close FROM prices WHERE tic IN (SELECT tic FROM membership WHERE snap_date >= DATE '2001-01-01')")
def universe_filter(spark, sf):
    recent = P.membership(spark, sf).filter(F.col("snap_date") >= F.lit("2001-01-01").cast("date"))
    return K.universe_filter(P.prices(spark, sf).select("tic", "date", "close"), recent)


@query("ticker_normalise", """
WITH o AS (SELECT o_custkey, string_agg(DISTINCT ' S.' || o_orderpriority || ' ', ',' ORDER BY ' S.' || o_orderpriority || ' ') AS names FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_transform(string_split(names, ','), lambda x: replace(trim(x), '.', '-')), '|') AS names FROM o""")
def ticker_normalise(spark, sf):
    label = F.concat(F.lit(" S."), F.col("o_orderpriority"), F.lit(" "))
    o = P.table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat_ws(",", F.array_sort(F.collect_set(label))).alias("names"))
    return o.select("o_custkey", F.concat_ws("|", K.ticker_normalise(F.col("names"))).alias("names"))


@query("zscore_normalise_global", """
WITH z AS (SELECT tic, date, (ret - (SELECT avg(ret) FROM day_returns)) / (SELECT stddev_samp(ret) FROM day_returns) AS r,
  (volume - (SELECT avg(volume) FROM day_returns)) / (SELECT stddev_samp(volume) FROM day_returns) AS v FROM day_returns)
SELECT tic, date, """ + qcut("r") + " AS ret, " + qcut("v") + " AS volume, 0.0::DOUBLE AS flat FROM z")
def zscore_normalise_global(spark, sf):
    d = day_returns(spark, sf).select("tic", "date", "ret", "volume", F.lit(3.0).alias("flat"))
    z = K.zscore_normalise_global(d, ["ret", "volume", "flat"])
    return z.select("tic", "date", cut(F.col("ret")).alias("ret"), cut(F.col("volume")).alias("volume"), "flat")


@query("full_coverage_dates", """
SELECT tic, datadate, price FROM quarter_closes WHERE datadate IN (
  SELECT datadate FROM quarter_closes GROUP BY 1 HAVING count(DISTINCT tic) = (SELECT count(DISTINCT tic) FROM quarter_closes))""")
def full_coverage_dates(spark, sf):
    return K.full_coverage_dates(P.quarter_closes(spark, sf), "datadate")


@query("sufficient_history", """
SELECT tic, count(*) FILTER (WHERE date <= DATE '1998-06-30') AS rows FROM prices GROUP BY 1
HAVING count(*) FILTER (WHERE date <= DATE '1998-06-30') < (SELECT count(*) FILTER (WHERE date <= DATE '1998-06-30') / count(DISTINCT tic) FROM prices)""".replace(
    "(SELECT count(*) FILTER (WHERE date <= DATE '1998-06-30') / count(DISTINCT tic) FROM prices)", "280"))
def sufficient_history(spark, sf):
    return K.sufficient_history(P.prices(spark, sf), "1998-06-30", 280)


@query("date_format_coalesce", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""")
def date_format_coalesce(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd"))
        .when(k == 2, F.date_format(d, "MM/dd/yyyy")).when(k == 3, F.date_format(d, "d MMM yyyy")).otherwise("n/a")
    )
    return P.table(spark, sf, "orders").select("o_orderkey", K.date_format_coalesce(text).alias("date"))


def statements(spark, sf):
    """Quarterly statements and ratios from the fundamentals, with gaps on purpose."""
    f = P.fundamentals(spark, sf).withColumn("m", F.col("n") % 6)
    base = [F.col("tic"), F.col("quarter_start").alias("quarter")]
    c, m = F.col, F.col("m")
    income = f.filter(c("n") % 13 != 0).select(
        *base, (c("net_revenue") - c("revenue") * 0.9).alias("netIncome"), c("revenue"),
        F.when(m == 1, c("net_revenue") / c("shares")).alias("eps"), c("shares").alias("weightedAverageShsOutDil"),
        F.lit(0.1).alias("netIncomeRatio"),
    )
    balance = f.filter(c("n") % 11 != 0).select(
        *base, F.when(m == 2, 0.0).otherwise(c("shares") + 5).alias("commonStockSharesOutstanding"),
        F.when(m == 3, 0.0).otherwise(c("gross") - c("net_revenue")).alias("totalStockholdersEquity"),
        c("gross").alias("totalCurrentAssets"), F.when(m == 4, 0.0).otherwise(c("revenue")).alias("totalCurrentLiabilities"),
        F.when(m == 5, 0.0).otherwise(c("shares")).alias("inventory"), c("n").cast("double").alias("inventoryAndOtherCurrentAssets"),
        (c("gross") / 4).alias("cashAndShortTermInvestments"), c("net_revenue").alias("totalLiabilities"), c("gross").alias("totalAssets"),
    )
    cash = f.select(*base, (-c("revenue") / 20).alias("dividendsPaid"), F.when(m == 0, 0.0).otherwise(-c("revenue") / 10).alias("commonDividendsPaid"))
    ratios = f.select(
        *base, F.when(m == 0, c("gross") / c("revenue")).alias("currentRatio"), F.when(m == 1, "n/a").otherwise("0.5").alias("dividendPerShare"),
        F.when(m < 3, 12.0).alias("priceEarningsRatio"), F.when(m == 3, 0.2).alias("netProfitMargin"),
        F.when(m == 4, 0.0).otherwise(2.5).alias("debtEquityRatio"), F.lit(3.5).alias("priceToSalesRatio"),
        F.when(m == 5, 4.5).alias("receivablesTurnover"), F.lit(1.25).alias("accountsReceivableTurnover"),
    )
    price = P.quarter_closes(spark, sf).select("tic", F.trunc("datadate", "quarter").alias("quarter"), "price")
    return income, balance, cash, ratios, price


_FACTORS = ("EPS", "BPS", "DPS", "cur_ratio", "quick_ratio", "cash_ratio", "acc_rec_turnover", "debt_ratio", "debt_to_equity", "pe", "ps", "pb", "roe", "net_income_ratio")
_FACTOR_SQL = """
WITH f AS (SELECT *, n % 6 AS m, n % 13 <> 0 AS has_i, n % 11 <> 0 AS has_b FROM fundamentals),
s AS (SELECT tic, quarter_start AS quarter, price, m, gross, revenue, net_revenue, has_i, has_b, n, shares AS sh,
  coalesce(CASE WHEN has_b AND m <> 2 THEN shares + 5 END, CASE WHEN has_i THEN shares END) AS so,
  CASE WHEN has_b AND m <> 3 THEN gross - net_revenue ELSE 0 END AS eq,
  CASE WHEN has_i THEN net_revenue - revenue * 0.9::DOUBLE END AS ni
  FROM f LEFT JOIN (SELECT tic, CAST(date_trunc('quarter', datadate) AS DATE) AS quarter_start, price FROM quarter_closes) USING (tic, quarter_start)),
e AS (SELECT *, coalesce(CASE WHEN has_i AND m = 1 THEN net_revenue / sh END, ni / so) AS "EPS", eq / so AS "BPS" FROM s)
SELECT tic, quarter, "EPS", "BPS",
  CASE WHEN m <> 1 THEN 0.5 ELSE revenue / 10 / so END AS "DPS",
  coalesce(CASE WHEN m = 0 THEN gross / revenue END, CASE WHEN has_b AND m <> 4 THEN gross / revenue END) AS cur_ratio,
  CASE WHEN has_b AND m <> 4 THEN (gross - CASE WHEN m = 5 THEN n ELSE sh END) / revenue END AS quick_ratio,
  CASE WHEN has_b AND m <> 4 THEN gross / 4 / revenue END AS cash_ratio,
  CASE WHEN m = 5 THEN 4.5 ELSE 1.25 END AS acc_rec_turnover,
  CASE WHEN has_b THEN net_revenue / gross END AS debt_ratio,
  CASE WHEN m <> 4 THEN 2.5 WHEN has_b AND eq <> 0 THEN net_revenue / eq END AS debt_to_equity,
  CASE WHEN m < 3 THEN 12.0 WHEN "EPS" <> 0 THEN price / "EPS" END AS pe, 3.5 AS ps,
  CASE WHEN "BPS" <> 0 THEN price / "BPS" END AS pb, CASE WHEN eq <> 0 THEN ni / eq END AS roe,
  CASE WHEN m = 3 THEN 0.2 WHEN has_i THEN 0.1 END AS net_income_ratio FROM e"""


@query("fundamental_factors", f"WITH facts AS ({_FACTOR_SQL}) SELECT tic, quarter, " + ", ".join(f'{qcut(chr(34) + c + chr(34))} AS "{c}"' for c in _FACTORS) + " FROM facts")
def fundamental_factors(spark, sf):
    d = K.fundamental_factors(*statements(spark, sf))
    return d.select("tic", "quarter", *(cut(F.col(c)).alias(c) for c in _FACTORS))


_FIELDS = list(K.RATIO_FIELDS.items())


@query("ratio_field_projection", "SELECT tic, quarter_start, " + ", ".join(
    f"CASE WHEN (n + {i}) % 5 <> 0 AND (n + {i}) % 7 <> 0 THEN CAST(n * {i + 1} AS DOUBLE) / 8 END AS {ours}" for i, (_, ours) in enumerate(_FIELDS)
) + " FROM fundamentals")
def ratio_field_projection(spark, sf):
    n = F.col("n")
    raw = P.fundamentals(spark, sf).select("tic", "quarter_start", *(
        F.when((n + i) % 5 == 0, None).when((n + i) % 7 == 0, "n/a").otherwise((n * (i + 1) / F.lit(8)).cast("string")).alias(theirs)
        for i, (theirs, _) in enumerate(_FIELDS)
    ))
    return K.ratio_field_projection(raw, ["tic", "quarter_start"])


@query("sentiment_parse", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN NULL WHEN 4 THEN 'neutral' WHEN 5 THEN 'negative' ELSE NULL END AS sentiment,
       CASE event_id % 7 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) / 4 + 1 WHEN 1 THEN 0.25 END::DOUBLE AS confidence FROM events""")
def sentiment_parse(spark, sf):
    k = F.col("event_id") % 7
    conf = ((F.col("event_id") % 100) / F.lit(4) + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('{"sentiment": "Positive", "confidence": '), conf, F.lit("}")))
        .when(k == 1, F.lit('{"label": "NEGATIVE", "confidence": 0, "score": 0.25}'))
        .when(k == 2, F.lit("Overall a Neutral, then negative tone"))
        .when(k == 3, F.col("props"))
        .when(k == 4, F.lit('{"sentiment": "mixed", "note": "neutral"}'))
        .when(k == 5, F.lit('{"sentiment": "negative", "confidence": "high"}'))
        .otherwise(F.lit(""))
    )
    s, c = K.sentiment_parse(text)
    return P.table(spark, sf, "events").select("event_id", s.alias("sentiment"), c.alias("confidence"))


@query("missing_sentiment_rows", """
SELECT doc_id, title, md5(trim(coalesce(text, ''))) AS body_md5, CAST(length(trim(coalesce(text, ''))) AS BIGINT) AS chars
FROM news LEFT JOIN labels USING (doc_id) WHERE coalesce(CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN ' ' END, '') IN ('', ' ')""")
def missing_sentiment_rows(spark, sf):
    lab = P.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, " ").alias("sentiment"))
    n = news(spark, sf).select("doc_id", "title", F.col("text").alias("body")).join(lab, "doc_id", "left")
    m = K.missing_sentiment_rows(n)
    return m.select("doc_id", "title", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("chars"))
