"""Direct learners of full size: validated trees for all horizons, refits, searches, whole-way labels, final forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import datasets, forecasters
from barloom.operators.ordered import split_by_share
from barloom.plans import flows
from barloom.plans.staging import stage

RNG = np.random.default_rng(33)
N = 300


@pytest.fixture(scope="module")
def table(spark):
    """Labels of horizon 1 are a sum of steps in all features, of horizon 2 a step in the first; that of horizon 3 is noise."""
    rows = []
    for i in range(N):
        x = [float(v) for v in RNG.integers(0, 6, 3)]
        step, steps = (2.0 if x[0] >= 3 else -2.0), sum(2.0 if v >= 3 else -2.0 for v in x)
        split = "train" if i < 200 else "valid" if i < 250 else "test"
        rows.append(("a", i + 1, split, x, steps, -step + 0.1 * RNG.normal(), float(RNG.normal())))
    names = "series_id string, pos long, split string, features array<double>, label_1 double, label_2 double, label_3 double"
    return stage(spark.createDataFrame(rows, names), "learner-rows")


def test_all_horizons_with_validated_rounds(table):
    learner = forecasters.validated_trees(maxIter=12, stepSize=0.5, maxDepth=1)
    fits = forecasters.fit_horizons(table, learner, [1, 2, 3])
    assert list(fits) == [1, 2, 3]
    trees = {h: m.getNumTrees for h, m in fits.items()}
    assert trees[3] < trees[1] <= 12  # noise stops the growth at once
    test = table.where("split = 'test'").withColumn("vector", forecasters.array_to_vector("features"))
    for h, most in ((1, 2.5), (2, 0.6)):
        error = fits[h].transform(test).agg(F.max(F.abs(F.col("scaled") - F.col(f"label_{h}")))).first()[0]
        assert error < most
    again = forecasters.refit(fits[3], table, learner, 3)
    assert again.getNumTrees == max(1, trees[3])
    assert forecasters.with_rounds_of(forecasters.linear_learner(), None).getRegParam() == 1e-6
    with pytest.raises(ValueError):
        forecasters.fit_validated(table.where("split <> 'valid'"), learner, 1)
    with pytest.raises(ValueError):
        forecasters.fit_horizons(table, learner, [1, 9])


def test_pruned_search_ends_with_the_best_of_the_full_one(table):
    trials = {f"step_{s}": forecasters.boosted_trees(stepSize=s, maxDepth=1) for s in (0.02, 0.1, 0.3, 0.9)}
    pruned = forecasters.pruned_search(table, trials, 1, (1, 2, 4)).collect()
    full = forecasters.grid_search(table, {n: t.copy({t.maxIter: 4}) for n, t in trials.items()}, 1).collect()
    assert pruned[0].trial == full[0].trial and abs(pruned[0].mae - full[0].mae) < 1e-12
    assert len(pruned) == 4 and 0 < sum(r.pruned for r in pruned) < 4 and {r.rounds for r in pruned if not r.pruned} == {4}
    with pytest.raises(ValueError):
        forecasters.pruned_search(table, trials, 2, (4, 2))
    assert len(forecasters.random_trees(15)) == 15
    same = [t.getMaxDepth() for t in forecasters.random_trees(5).values()]
    assert same == [t.getMaxDepth() for t in forecasters.random_trees(5).values()]


def test_whole_way_labels(series, frame):
    n = 120
    r = RNG.normal(0, 0.01, n)
    data = {"a": {"close": 100 * np.exp(np.cumsum(r)), "r": r, "rsi_state": ["Neutral"] * n}}
    m = stage(datasets.model_matrix(split_by_share(series(data)), ["r"], "r", 64), "matrix")
    table = frame(datasets.lag_feature_table(m, 3, [1, 5], 64, label="cumulative"))
    z = frame(m)["z"].to_numpy()
    train = table[(table["split"] == "train") & table["label_5"].notna()]
    for _, row in train.iterrows():
        np.testing.assert_allclose(row["label_5"], z[row["pos"] : row["pos"] + 5].sum(), atol=1e-12)
    fitted = forecasters.fit_direct(datasets.lag_feature_table(m, 3, [5], 64, label="cumulative"), forecasters.linear_learner(), 5)
    got = frame(forecasters.apply_direct(fitted, datasets.walk_forward_frames(m, 3, 5, "test", block_rows=64), "line", rows_ahead=5))
    np.testing.assert_allclose(got["pred"], got["base"] * np.exp(got["pred_return"]))
    np.testing.assert_allclose(got["true_return"], np.log(got["true"] / got["base"]))
    with pytest.raises(ValueError):
        datasets.lag_feature_table(m, 3, [1], label="other")


def test_every_model_forecasts(series):
    n = 200
    r = RNG.normal(0, 0.01, n)
    close = 100 * np.exp(np.cumsum(r))
    df = split_by_share(series({"a": {"close": close, "log_returns_close": r, "rsi_state": ["Neutral"] * n}}))
    df = stage(df, "rows")
    learners = {"line": forecasters.linear_learner(), "trees": forecasters.validated_trees(maxIter=3, maxDepth=2)}
    done = flows.evaluate_models(df, df, ["log_returns_close"], 3, 4, (1, 1, 0), learners, ar_window=20)
    got = {r.model: r for r in done.forecasts.collect()}
    assert set(got) == {"persistence", "ar(1,1,0)", "line", "trees", "stack_line", "stack_trees"}
    assert {r.ts_future for r in got.values()} == {"2024-07-21"}
    assert got["persistence"].pred == close[-1] and all(abs(r.pred / close[-1] - 1) < 0.5 for r in got.values())
    models = {r.model for r in done.predictions.select("model").distinct().collect()}
    assert models == set(got)
