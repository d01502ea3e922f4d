import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import autoregression as ar
from barloom.operators import datasets, forecasters, joins, linear, metrics
from barloom.operators.ordered import split_by_share

RNG = np.random.default_rng(21)
N = 200


@pytest.fixture(scope="module")
def matrix_data():
    state = np.array(["Neutral", "Oversold"])[RNG.integers(0, 2, N)].tolist()
    state[-1] = "Overbought"  # only in test
    return {"close": 100 + RNG.normal(0, 1, N).cumsum(), "r": RNG.normal(0, 1, N), "flat": np.full(N, 3.0), "rsi_state": state}


def test_scaling_uses_train_and_population_deviation(series, frame, matrix_data):
    df = split_by_share(series({"a": matrix_data}))
    got = frame(datasets.standard_scale(df, ["r", "flat"], 64))
    r = matrix_data["r"]
    np.testing.assert_allclose(got["z_r"], (r - r[:160].mean()) / r[:160].std(), rtol=1e-9)
    assert (got["z_flat"] == 0).all()
    hot = frame(datasets.one_hot_state(df, block_rows=64))
    assert hot.iloc[-1][datasets.state_columns()].tolist() == [0, 0, 0]
    assert (hot["state_Oversold"] == (hot["rsi_state"] == "Oversold")).all()


@pytest.mark.parametrize("rows", [16, 65_536])
def test_windows(series, frame, matrix_data, rows):
    w, t = 5, 3
    df = split_by_share(series({"a": matrix_data, "b": {k: v[:90] for k, v in matrix_data.items()}}))
    m = datasets.model_matrix(df, ["r", "flat"], "r", rows)
    seq = frame(datasets.seq2seq_windows(m, w, t, rows))
    for key, n in (("a", N), ("b", 90)):
        sizes = {"train": int(n * 0.8), "valid": int(n * 0.1)}
        sizes["test"] = n - sum(sizes.values())
        counts = seq[seq.series_id == key]["split"].value_counts()
        assert {s: max(0, k - w - t + 1) for s, k in sizes.items()} == {s: counts.get(s, 0) for s in sizes}
    z = frame(m)
    z = z[z.series_id == "a"]["z"].to_numpy()
    first = seq[(seq.series_id == "a")].iloc[0]
    for i, target in enumerate(first["targets"]):
        np.testing.assert_allclose(target, z[i + 1 : i + 1 + t])
    table = frame(datasets.lag_feature_table(m, w, [1, 3], rows))
    a = table[table.series_id == "a"].reset_index(drop=True)
    train = a[(a["split"] == "train") & a["label_3"].notna()]
    assert len(train) == 160 - w - 3 + 1
    np.testing.assert_allclose(train["label_3"], z[w + 2 : 160])
    np.testing.assert_allclose(a.iloc[0]["features"][:: 5][:w], z[:w])
    for align, shift in (("strict", 0), ("reference", 1)):
        walk = frame(datasets.walk_forward_frames(m, w, 3, "test", align, rows))
        walk = walk[walk.series_id == "a"].reset_index(drop=True)
        assert walk["pos"].tolist() == list(range(184, 201))
        base = 181 - 1  # index of the first base row
        np.testing.assert_allclose(walk.iloc[0]["features"][:: 5][-1], z[base - shift])
        np.testing.assert_allclose(walk["base"], matrix_data["close"][180:197])
        np.testing.assert_allclose(walk["true"], matrix_data["close"][183:200])
    with pytest.raises(ValueError):
        datasets.walk_forward_frames(m, w, 3, "test", "other")


def test_least_squares(series, frame):
    x1, x2 = RNG.normal(1e5, 1e3, 80), RNG.normal(0, 1e-3, 80)
    y = 3 + 2 * x1 - 500 * x2 + RNG.normal(0, 1, 80)
    got = linear.least_squares(series({"a": {"y": y, "u": x1, "v": x2}, "b": {"y": y[:9], "u": x1[:9], "v": x2[:9]}}), "y", ["u", "v"])
    for row in got.collect():
        n = 80 if row.series_id == "a" else 9
        want, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), x1[:n], x2[:n]]), y[:n], rcond=None)
        np.testing.assert_allclose(row.coefficients[1:], want[1:], rtol=1e-4)
        assert row.m == n


def test_autoregression_recovers_coefficients(series, frame):
    n = 3000
    e = RNG.normal(0, 0.01, n)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] - 0.2 * y[t - 2] + e[t] + 0.4 * e[t - 1]
    df = series({"a": {"close": 100 * np.exp(np.cumsum(y))}}).withColumn("split", F.lit("train"))
    got = ar.fit_orders(df, "close", [(2, 1, 1), (2, 1, 0)], block_rows=700).collect()
    both = next(r for r in got if r.q == 1)
    np.testing.assert_allclose([*both.phi, *both.theta], [0.5, -0.2, 0.4], atol=0.08)
    assert both.const == 0
    with pytest.raises(ValueError):
        ar.fit_orders(df, "close", [(1, 1)])


def squares(y, const, phi, theta):
    """The conditional sum of squares by its recursion."""
    e = np.zeros(len(y))
    for t in range(len(phi), len(y)):
        e[t] = y[t] - const - sum(f * y[t - 1 - i] for i, f in enumerate(phi)) - sum(w * e[t - 1 - j] for j, w in enumerate(theta) if t > j)
    return e @ e


@pytest.mark.parametrize("rows", [700, 65_536])
def test_conditional_squares_fall_and_parameters_are_recovered(series, rows):
    rng = np.random.default_rng(4)
    n = 2500
    e = rng.normal(0, 0.01, n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.6 * y[t - 1] + e[t] - 0.5 * e[t - 1]  # nearly cancels: hard for the first fit
    ma = e + 0.9 * np.r_[0, e[:-1]]
    data = {"a": {"close": 100 * np.exp(np.cumsum(y))}, "b": {"close": 100 * np.exp(np.cumsum(ma))}, "c": {"close": np.exp(5 + ma[:400])}}
    df = series(data).withColumn("split", F.lit("train"))
    orders = [(1, 1, 1), (0, 1, 1), (2, 0, 2), (1, 1, 0)]
    first = {(r.series_id, r.p, r.d, r.q): r for r in ar.fit_orders(df, "close", orders, block_rows=rows, refine=False).collect()}
    last = {(r.series_id, r.p, r.d, r.q): r for r in ar.fit_orders(df, "close", orders, block_rows=rows).collect()}
    assert set(first) == set(last) and len(first) == 12
    for key, fit in last.items():
        logs = np.log(data[key[0]]["close"])
        values = np.diff(logs, n=key[2]) if key[2] else logs
        before, after = (squares(values, f.const, f.phi, f.theta) for f in (first[key], fit))
        assert after <= before * (1 + 1e-9)
    np.testing.assert_allclose([*last["a", 1, 1, 1].phi, *last["a", 1, 1, 1].theta], [0.6, -0.5], atol=0.15)
    np.testing.assert_allclose(last["b", 0, 1, 1].theta, [0.9], atol=0.03)


def test_conditional_sums_against_differences():
    y = RNG.normal(0, 1, 120)
    y[40] = np.nan
    beta, own = np.array([0.1, 0.5, -0.2, 0.4, 0.3]), np.arange(120) >= 30
    sse, normal, slope = ar.conditional_sums(y, own, True, 2, beta)
    for i in range(5):
        step = np.zeros(5)
        step[i] = 1e-5
        up, down = (ar.conditional_sums(y, own, True, 2, beta + s)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - 2 * slope[i]) < 1e-4 * max(1, abs(slope[i]))
    assert np.linalg.eigvalsh(normal).min() > 0 and sse > 0


@pytest.mark.parametrize("d", [0, 1, 2])
def test_projection_against_recursion(d):
    x = RNG.normal(0, 1, (3, 25)).cumsum(axis=1)
    phi, theta, const = np.array([0.5, -0.3]), np.array([0.4, 0.1]), 0.2 if d == 0 else 0.0
    shift, weights = ar.forecast_weights(25, d, const, phi, theta, 4)
    got = shift + x @ weights
    for row, value in zip(x, got):
        y = np.diff(row, n=d) if d else row.copy()
        e = [0.0] * len(y)
        for t in range(2, len(y)):
            e[t] = y[t] - const - phi[0] * y[t - 1] - phi[1] * y[t - 2] - sum(theta[j] * e[t - 1 - j] for j in range(2) if t - 1 - j >= 0)
        y, e = list(y), list(e)
        for _ in range(4):
            y.append(const + phi[0] * y[-1] + phi[1] * y[-2] + theta[0] * e[-1] + theta[1] * e[-2])
            e.append(0.0)
        levels = np.array(y[-4:])
        for k in range(d - 1, -1, -1):
            levels = np.diff(row, n=k)[-1] + np.cumsum(levels)
        assert abs(value - levels[-1]) < 1e-9


def test_ar_backtest_matches_a_loop(series, frame):
    close = 100 * np.exp(np.cumsum(RNG.normal(0, 0.01, 240)))
    df = split_by_share(series({"a": {"close": close}}))
    got = frame(ar.ar_backtest(df, (2, 1, 0), 30, 3, block_rows=50))
    fit = ar.fit_orders(df, "close", [(2, 1, 0)], ("train", "valid")).first()  # what comes before the test
    n = 240
    first = int(n * 0.8) + int(n * 0.1)
    assert got["pos"].tolist() == list(range(first + 3 + 1, n + 1))
    for _, row in got.iterrows():
        t = row["pos"] - 1 - 3  # index of the base row; the history ends before it
        x, y = np.log(close[t - 1]), np.diff(np.log(close[t - 3 : t]))
        for _ in range(4):
            y = np.r_[y, fit.phi[0] * y[-1] + fit.phi[1] * y[-2]]
            x += y[-1]
        want = np.exp(x)
        assert abs(row["pred"] / want - 1) < 1e-9 and row["base"] == close[t]


def test_error_weights_are_made_invertible():
    np.testing.assert_allclose(ar.invertible(np.array([0.4, -0.2])), [0.4, -0.2])
    np.testing.assert_allclose(ar.invertible(np.array([2.0])), [0.5])  # same autocorrelation: 2/5
    np.testing.assert_allclose(ar.invertible(np.array([1.0])), [ar.EDGE])
    got = ar.invertible(np.array([2.5, 1.0]))  # inverse roots -2 and -1/2
    np.testing.assert_allclose(got, [1.0, 0.25])
    assert ar.memory(3, 1, np.zeros(0)) == 4 + 1
    assert ar.memory(0, 0, np.array([0.5])) == 2 + 100
    assert ar.forecast_weights(2, 1, 0.0, np.array([0.1, 0.1]), np.zeros(0), 1) is None


@pytest.mark.parametrize("order", [(2, 1, 2), (1, 0, 1), (0, 2, 1)])
def test_forecast_carries_errors_over_the_whole_history(series, order):
    n, h = 300, 4
    e = RNG.normal(0, 0.01, n + 1)
    close = 100 * np.exp(np.cumsum(e[1:] + 0.9 * e[:-1]))
    df = split_by_share(series({"a": {"close": close}, "b": {"close": close[:120]}, "short": {"close": close[:2]}}))
    fits = {r.series_id: r for r in ar.fit_orders(df, "close", [order], ("train", "valid", "test")).collect()}
    rows = 64 if order == (1, 0, 1) else 65_536  # in rounds over blocks, or in one task
    got = {r.series_id: r.pred for r in ar.ar_forecast(df, order, h, "D", block_rows=rows).collect()}
    for key, size in (("a", n), ("b", 120)):
        f, logs = fits[key], np.log(close[:size])
        y = list(np.diff(logs, n=order[1]) if order[1] else logs)
        errors = [0.0] * len(y)
        guess = lambda t: f.const + sum(c * y[t - 1 - i] for i, c in enumerate(f.phi)) + sum(c * errors[t - 1 - j] for j, c in enumerate(f.theta) if t - 1 - j >= 0)
        for t in range(order[0], len(y)):
            errors[t] = y[t] - guess(t)
        for _ in range(h):
            y.append(guess(len(y)))
            errors.append(0.0)
        levels = np.array(y[-h:])
        for k in range(order[1] - 1, -1, -1):
            levels = (np.diff(logs, n=k) if k else logs)[-1] + np.cumsum(levels)
        assert abs(got[key] / np.exp(levels[-1]) - 1) < 1e-9


def test_predictions_need_no_python_over_rows(series):
    df = split_by_share(series({"a": {"close": 100 + RNG.normal(0, 1, 200).cumsum()}}))
    fitted = df.sparkSession.createDataFrame([("a", 1, 1, 0, 0.0, [0.5], [])], "series_id string, p int, d int, q int, const double, phi array<double>, theta array<double>")
    plan = ar.backtest_orders(df, "close", fitted, 30, 3, "test")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "PythonUDF" not in plan  # the weights, a row for each order


def test_stack_and_scores(series, frame):
    close = 100 + RNG.normal(0, 5, 300)
    df = split_by_share(series({"a": {"close": close}}))
    bases = ["mean_3", "mean_9"]
    both = {s: joins.union_splits(*[forecasters.trailing_mean(df, 2, n, s, 64) for n in (3, 9)]) for s in ("valid", "test")}
    meta = forecasters.stack_fit(both["valid"], bases)
    got = frame(forecasters.stack_predictions(both["test"], meta, bases, block_rows=64))
    c = pd.Series(close)
    m3, m9 = c.rolling(3).mean().shift(2), c.rolling(9).mean().shift(2)
    v, t = slice(242, 270), slice(272, 300)
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(28), m3[v], m9[v]]), close[v], rcond=None)
    np.testing.assert_allclose(got["pred"], beta[0] + beta[1] * m3[t] + beta[2] * m9[t], rtol=1e-6)
    scored = metrics.score(both["test"].unionByName(forecasters.persistence(df, 2, "test"))).toPandas().set_index("model")
    y = close[t]
    assert abs(scored.loc["mean_3", "mape"] - (np.abs(y - m3[t]) / y).mean() * 100) < 1e-9
    hit = np.sign(y - close[270:298]) == np.sign(m9[t] - close[270:298])
    assert abs(scored.loc["mean_9", "da"] - hit.mean() * 100) < 1e-9


def test_selection(spark):
    rows = [("a", "naive", 5.0, 50.0), ("a", "x", 4.0, 55.0), ("a", "y", 3.0, 55.0), ("a", "z", 9.0, 99.0), ("b", "naive", 1.0, 50.0), ("b", "x", 2.0, 60.0)]
    df = spark.createDataFrame(rows, "series_id string, model string, mape double, da double")
    assert [tuple(r) for r in metrics.select_best(df, "naive").collect()] == [("a", "y", 3.0, 55.0)]
    assert [r.model for r in metrics.leaderboard(df.where("series_id = 'a'")).collect()] == ["z", "y", "x", "naive"]
    assert metrics.leaderboard(df, "mape").first().mape == 1.0
    with pytest.raises(ValueError):
        metrics.leaderboard(df, "other")
    with pytest.raises(ValueError):
        forecasters.check_horizon(8, spark.createDataFrame([], "label_1 double, label_7 double"))


def test_empty_direction_defaults(series):
    df = series({"a": {"true": [1.0, 2.0], "pred": [1.0, 2.0]}}).withColumn("model", F.lit("m"))
    assert metrics.da_by_change(df, 5).first().da == 50.0
    history = series({"a": {"close": [1.0, 2.0]}})
    assert metrics.da_by_baseline(df, history, 5).first().da == 0.0


def test_naive_forecast_signal(series):
    df = series({"up": {"close": [1.0, 2.0]}, "hold": {"close": [100.0, 100.1]}, "zero": {"close": [0.0, -1.0]}})
    got = {r.series_id: (r.pred, r.sig, r.ts_future) for r in forecasters.naive_forecast(df, 7, "D").collect()}
    assert got == {"up": (2.0, 1.0, "2024-01-09"), "hold": (100.1, 0.0, "2024-01-09"), "zero": (-1.0, -1.0, "2024-01-09")}
