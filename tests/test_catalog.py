"""Registered queries against their SQL.  BARLOOM_ALL=1 checks every query."""

import os

import pytest
from oracle import compare, database

from barloom import catalog

SF = "/root/testdata/sf0.001"
ALL = catalog.load()
QUICK = [
    "scan_bars", "register_version", "resample_weekly", "direction_signal", "interpolate_linear", "outlier_classify",
    "ewm_mean", "macd_12_26_9", "mom_pct_lagged", "time_split", "boundary_split", "describe_exact", "monthly_box_stats",
    "acf", "seasonal_decompose", "ljung_box", "dm_test_all_pairs", "da_diff", "da_baseline", "feature_table",
    "lag_feature_table", "stack_forecast", "select_best_model",
]
CHOSEN = list(ALL) if os.environ.get("BARLOOM_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    q = ALL[name]
    problem = compare(spark, con, name, q, q.oracle, SF)
    assert not problem, problem


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
