"""Fits on joined splits, learners, and inputs that are short, constant, doubled or off the grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.probability import chi2_tail_value
from barloom.operators import datasets, forecasters, metrics, stats, tests_of_series
from barloom.operators.grid import fill_grid
from barloom.operators.ordered import split_by_share
from barloom.operators.quantiles import exact_quantiles

N, WINDOW, H = 180, 7, 7


@pytest.fixture(scope="module")
def features(spark):
    """One series whose return follows the sign of the value ``a`` seven rows before."""
    r = np.random.default_rng(9)
    a = r.normal(size=N)
    z = np.r_[np.zeros(H), np.where(a[:-H] > 0, 0.02, -0.01)]
    close = 100 * np.exp(np.cumsum(z))
    rows = [("s", k + 1, float(a[k]), float(z[k]), float(close[k]), "neutral") for k in range(N)]
    df = spark.createDataFrame(rows, "series_id string, pos long, a double, log_returns_close double, close double, rsi_state string")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + 86400 * F.col("pos")))
    return split_by_share(df).cache()


@pytest.mark.parametrize("rows", [7, 65536])
def test_refit_keeps_the_rows_between_train_and_valid(features, rows):
    numeric = ["a", "log_returns_close"]
    first = datasets.model_matrix(features, numeric, "log_returns_close", rows)
    again = datasets.model_matrix(features, numeric, "log_returns_close", rows, datasets.REFIT)
    history = features.where("split <> 'test'").toPandas()
    want = history.log_returns_close
    row = again.select("mean", "std").first()
    assert row.mean == pytest.approx(want.mean()) and row.std == pytest.approx(want.std(ddof=0))
    n = len(history)
    table = datasets.lag_feature_table(again, WINDOW, [H], rows, datasets.REFIT)
    assert table.where("split IN ('train', 'valid') AND label_7 IS NOT NULL").count() == n - WINDOW + 1 - H
    apart = datasets.lag_feature_table(first, WINDOW, [H], rows)
    assert apart.where("split IN ('train', 'valid') AND label_7 IS NOT NULL").count() == n - 2 * (WINDOW + H - 1)
    border = table.where("split = 'test' AND label_7 IS NOT NULL").count()
    assert border == N - n - WINDOW + 1 - H  # test windows never reach into the history they are tested on


@pytest.fixture(scope="module")
def learning(features):
    matrix = datasets.model_matrix(features, ["a", "log_returns_close"], "log_returns_close", fit_splits=datasets.REFIT).cache()
    return matrix, datasets.lag_feature_table(matrix, 1, [1, H], fit_splits=datasets.REFIT).cache()


def test_trees_recover_a_step(learning):
    matrix, table = learning
    fitted = forecasters.fit_direct(table, forecasters.boosted_trees(maxIter=20, stepSize=0.5), H, datasets.REFIT)
    got = forecasters.apply_direct(fitted, datasets.walk_forward_frames(matrix, 1, H, "test"), "trees").toPandas()
    assert len(got) == 18 - H
    up = datasets.walk_forward_frames(matrix, 1, H, "test").toPandas().sort_values("pos")
    sign = [f[0] > -0.1 for f in up.features]
    assert sum(s == (p > 0.005) for s, p in zip(sign, got.sort_values("pos").pred_return)) >= len(got) - 1


def test_last_window_is_the_one_forecast(learning):
    matrix, table = learning
    fitted = forecasters.fit_direct(table, forecasters.linear_learner(), H, datasets.REFIT)
    last = matrix.orderBy(F.desc("pos")).first()
    scaled = float(np.dot(fitted.coefficients.toArray(), last.x) + fitted.intercept)
    got = forecasters.direct_forecast(fitted, table, matrix, H, "D").first()
    assert got.pred == pytest.approx(last.close * math.exp(scaled * last.std + last.mean))
    with pytest.raises(ValueError):
        forecasters.fit_direct(table, forecasters.linear_learner(), 3)


def test_grid_search_orders_trials_by_error(learning):
    _, table = learning
    trials = {"shallow": forecasters.boosted_trees(maxIter=1, maxDepth=1, stepSize=0.01), "deep": forecasters.boosted_trees(maxIter=10, stepSize=0.5)}
    got = forecasters.grid_search(table, trials, H).collect()
    assert [r.trial for r in got] == ["deep", "shallow"] and got[0].mae < got[1].mae
    with pytest.raises(ValueError):
        forecasters.grid_search(table, {}, H)


def test_unit_root_of_unusable_series(series, frame):
    r = np.random.default_rng(1)
    df = series({"short": {"x": [1.0, 2.0, 4.0]}, "one": {"x": [1.0]}, "constant": {"x": [5.0] * 60}, "line": {"x": list(range(60))}, "good": {"x": np.cumsum(r.normal(size=200))}})
    got = {row.series_id: row for row in tests_of_series.adf_test(df, "x", 14).collect()}
    assert got["good"].stat is not None and got["good"].nobs > 150
    for key in ("short", "constant", "line"):
        assert got[key].stat is None and got[key].p_value is None
    alone = tests_of_series.adf_test(df.where("series_id = 'good'"), "x", 14).first()
    assert alone.stat == pytest.approx(got["good"].stat) and alone.used_lag == got["good"].used_lag


@pytest.mark.parametrize("df", [1, 2, 7, 14, 90])
def test_chi_square_tail(df):
    assert chi2_tail_value(1e10, df) == 0.0 and chi2_tail_value(0.0, df) == 1.0
    xs = np.linspace(1e-3, 300, 400_001)
    density = np.exp((df / 2 - 1) * np.log(xs) - xs / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    tail = density[xs >= 20].sum() * (xs[1] - xs[0])
    assert chi2_tail_value(20.0, df) == pytest.approx(tail, abs=1e-3)


def test_direction_of_two_models_in_one_table(series):
    r = np.random.default_rng(2)
    df = series({"s": {"true": r.normal(size=40), "x": r.normal(size=40), "y": r.normal(size=40)}})
    part = {m: df.select("series_id", F.lit(m).alias("model"), "ts", "pos", "true", F.col(m).alias("pred")) for m in ("x", "y")}
    both = {x.model: x.da for x in metrics.da_by_change(part["x"].union(part["y"]), 3, 7).collect()}
    assert both == {m: metrics.da_by_change(p, 3).first().da for m, p in part.items()}


def test_empty_bins_are_rows(series):
    df = series({"s": {"x": [0.0, 0.1, 10.0]}, "none": {"x": [None, None, None]}})
    got = sorted(stats.histogram(df, "x", 5).collect(), key=lambda r: r.bin)
    assert [(r.series_id, r["count"]) for r in got] == [("s", 2), ("s", 0), ("s", 0), ("s", 0), ("s", 1)]
    assert sum(r.density * (r.right - r.left) for r in got) == pytest.approx(1)


def test_scatter_points(series):
    df = series({"s": {"volume": [1.0, None, 3.0], "close": [4.0, 5.0, None]}})
    assert [(r.volume, r.close) for r in stats.price_volume_pairs(df).collect()] == [(1.0, 4.0)]


def test_rows_between_seconds_are_off_the_grid(spark):
    rows = [("s", "2024-01-01 00:00:00", 1.0), ("s", "2024-01-01 00:01:00.5", 9.0), ("s", "2024-01-01 00:02:00", 3.0)]
    df = spark.createDataFrame(rows, "series_id string, t string, close double").select("series_id", F.col("t").cast("timestamp").alias("ts"), "close")
    got = fill_grid(df, 60).orderBy("ts").collect()
    assert [r.close for r in got] == [1.0, None, 3.0]


def test_a_missed_bracket_is_an_error(series):
    r = np.random.default_rng(0)
    df = series({"s": {"x": r.normal(size=3000)}})
    got = exact_quantiles(df, ["series_id"], {"q": ("x", 0.37)}).first().q
    assert got == pytest.approx(np.quantile(df.toPandas().x, 0.37))
