"""What the physical plans must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, datasets, ewm, features, grid, metrics, ordered, outliers, stats
from barloom.operators.quantiles import exact_quantiles
from barloom.plans.blocks import accumulate, fill_forward, number_rows, register_blocks

BARS = {c: [1.0, 2.0, 3.0] for c in bars.BAR_COLUMNS}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


OPERATORS = {
    "number_rows": lambda d: number_rows(d.drop("pos"), 60),
    "fill_forward": lambda d: fill_forward(d, ["close"]),
    "accumulate": lambda d: accumulate(d, {"total": "volume"}, ["close"]),
    "grid": lambda d: grid.fill_gaps(d.drop("pos"), 60, ["close"]),
    "rolling": lambda d: ordered.rolling_mean(d, {"m": ("close", 3)}),
    "split": lambda d: ordered.split_by_share(d),
    "ewm": lambda d: ewm.ewm_mean(d, {"m": ("close", 0.1)}),
    "macd": lambda d: ewm.macd(d),
    "indicators": lambda d: features.technical_indicators(d),
    "quantiles": lambda d: exact_quantiles(d, ["series_id"], {"q": ("close", 0.5)}),
    "acf": lambda d: stats.autocorrelation(d, "close", 5),
    "decompose": lambda d: stats.seasonal_decompose(d, "close", 3),
    "histogram": lambda d: stats.histogram(d, "close", 5),
    "ranks": lambda d: stats.rank_by_value(d, "close"),
    "integrity": lambda d: outliers.integrity_report(d),
    "resample": lambda d: bars.resample_bars(d, "D"),
    "residuals": lambda d: metrics.residuals(d.withColumns({"model": F.lit("m"), "true": F.col("close"), "pred": F.col("open")})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_single_task_and_no_pairs(spark, series, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(OPERATORS[name](series({"a": BARS})))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # Series values join by block, never by series alone, when nothing is small enough to broadcast.
    for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", text):
        assert "," in keys or "_block" in keys, keys


def test_indicators_shuffle_rows_once_per_pass(series):
    """All frames of the indicators share one shuffle; the volume carry adds one pass."""
    text = plan(features.over_blocks(series({"a": BARS}), lambda t: features._frame_indicators(t, 50, 14, 14), 100))
    assert len(re.findall(r"Exchange hashpartitioning\(series_id", text)) == 1


def test_scan_reads_only_needed_columns(spark, tmp_path, series):
    path = str(tmp_path / "bars")
    series({"a": BARS}).write.parquet(path)
    text = plan(ordered.rolling_mean(spark.read.parquet(path), {"m": ("close", 3)}).select("series_id", "m"))
    assert "open" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    day = plan(grid.exclude_day(spark.read.parquet(path), "2024-01-02"))
    assert "PushedFilters: [Or(LessThan" in day


def test_registry_saves_reads_and_arrays(spark, tmp_path, series):
    """A split reads its rows once, and no array of block numbers is made for a series."""
    path = str(tmp_path / "bars")
    series({"a": BARS}).drop("pos").write.parquet(path)
    rows = spark.read.parquet(path)
    registry = register_blocks(rows, 86400)
    text = plan(ordered.split_by_share(number_rows(rows, 86400, registry=registry), registry=registry))
    assert text.count(path) == 1 and "sequence(" not in text
    scaled = datasets.standard_scale(number_rows(rows, 86400, registry=registry).withColumn("split", F.lit("train")), ["close"], registry=registry)
    assert "sequence(" not in plan(scaled)
