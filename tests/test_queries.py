"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
# The training-corpus queries have their own tests.
CORPUS = entry.corpus_queries.QUERIES if entry.corpus_queries else {}
NAMES = [n for n in entry.queries() if n not in CORPUS and n != "pipeline"]
# Queries whose result may have no row on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module", autouse=True)
def small_models():
    """Models of small sizes; the queries themselves use the full ones."""
    from stratapanel.plans import model_queries

    before = dict(model_queries.SIZES)
    model_queries.SIZES.update(trees=5, depth=3, rounds=3)
    yield
    model_queries.SIZES.clear()
    model_queries.SIZES.update(before)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    msg = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert msg is None or name in MAY_BE_EMPTY and msg in ("EMPTY", "no rows"), msg


def test_entry_has_weights(spark):
    df = entry.entry(spark)
    assert {"date", "tic", "weight", "cash"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize(("name", "shuffles"), [
    ("mixed_alpha", 25), ("dual_ensemble", 25), ("alpha_sensitivity", 25), ("long_only_quantile_portfolio", 25),
    ("price_on_or_after", 15), ("min_variance_weights", 25), ("multi_strategy_backtest", 25), ("portfolio_weights", 40),
])
def test_plans_stay_small(spark, name, shuffles):
    """Shuffles and scans of the trades as planned, before any stage is reused."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) < shuffles
    assert plan.count("lineitem.parquet") <= 2


def test_csv_files_are_written_by_many_tasks(spark):
    listings = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listings, None)
    files = entry.queries()["price_csv_scan"](spark, SF).inputFiles()
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1  # joined by bytes they were one task's
    assert spark.conf.get(listings, None) == before
