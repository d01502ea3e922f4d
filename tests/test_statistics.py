import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import probability as P
from barloom.operators import stats
from barloom.operators import tests_of_series as tests
from barloom.operators.quantiles import exact_quantiles

RNG = np.random.default_rng(11)
PROBS = {"lo": 0.0, "a": 0.05, "q": 0.25, "m": 0.5, "x": 0.9999, "hi": 1.0}


@pytest.mark.parametrize("accuracy", [40, 100_000])
@pytest.mark.parametrize("rows", [50, 65_536])
def test_quantiles_are_exact_with_ties_and_a_hot_series(series, frame, accuracy, rows):
    """A third of the rows hold one value; a coarse sketch must still give the exact answer."""
    hot = np.concatenate([np.full(300, 2.5), RNG.normal(0, 3, 600)])
    data = {"hot": {"x": hot}, "b": {"x": RNG.integers(0, 5, 37).astype(float)}, "one": {"x": [4.0]}}
    quantiles = {k: ("x", p) for k, p in PROBS.items()}
    got = frame(exact_quantiles(series(data), ["series_id"], quantiles, accuracy, rows), "lo").set_index("series_id")
    for key, columns in data.items():
        want = np.quantile(columns["x"], list(PROBS.values()))
        np.testing.assert_allclose(got.loc[key, list(PROBS)].to_numpy(dtype=float), want, rtol=1e-12)


@pytest.mark.parametrize("range_rows", [10, 1 << 20])
def test_missed_brackets_are_widened(series, frame, range_rows):
    """Brackets without width miss nearly every rank at first; the answer is exact all the same, by ranges too."""
    x = RNG.normal(0, 3, 700)
    got = frame(
        exact_quantiles(series({"a": {"x": x}, "b": {"x": x[:90]}}), ["series_id"], {"q": ("x", 0.37), "m": ("x", 0.5)}, 5, margin=0.0, range_rows=range_rows), "q"
    ).set_index("series_id")
    for key, part in (("a", x), ("b", x[:90])):
        np.testing.assert_allclose(got.loc[key, ["q", "m"]].to_numpy(dtype=float), np.quantile(part, [0.37, 0.5]), rtol=1e-12)


def test_density_rows_follow_points_not_values(series, frame, spark):
    """The map side gives a row for each point, series and task, however many values there are."""
    x, points = RNG.normal(0, 1, 4000), 50
    df = series({"a": {"x": x}, "b": {"x": x[:700]}})
    spans = df.groupBy("series_id").agg(F.lit(0.5).alias("_h"), F.min("x").alias("_low"), F.lit(0.1).alias("_step"))
    placed = df.withColumnRenamed("x", "_x").join(F.broadcast(spans), "series_id").select("series_id", "_x", "_h", "_low", "_step").coalesce(3)
    sums = placed.mapInArrow(lambda b: stats._density_sums(b, points), "series_id string, point int, _s double")
    assert sums.count() <= points * 2 * 3
    got = frame(stats.kernel_density(df, "x", points), "point")
    for key, part in (("a", x), ("b", x[:700])):
        h = part.std(ddof=1) * len(part) ** -0.2
        at = np.linspace(part.min(), part.max(), points)
        want = np.exp(-(((at[:, None] - part) / h) ** 2) / 2).sum(axis=1) / (len(part) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(got[got.series_id == key]["density"], want, rtol=1e-9)


@pytest.mark.parametrize("rows", [16, 65_536])
def test_ranks_with_ties(series, frame, rows):
    x = np.concatenate([np.full(100, 1.0), RNG.normal(0, 1, 211)])
    got = frame(stats.rank_by_value(series({"a": {"x": x}, "b": {"x": x[:5]}}), "x", rows, 20), "rank")
    for key, want in (("a", np.sort(x)), ("b", np.sort(x[:5]))):
        part = got[got.series_id == key]
        assert part["rank"].tolist() == list(range(1, len(want) + 1))
        np.testing.assert_array_equal(part["value"], want)


def acf_of(x, lags):
    d = x - x.mean()
    return np.array([1.0] + [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, lags + 1)])


@pytest.mark.parametrize("rows", [20, 65_536])
def test_correlations(series, frame, rows):
    x = RNG.normal(0, 1, 300)
    for i in range(1, 300):
        x[i] += 0.7 * x[i - 1]
    holes = np.insert(x, [5, 100], np.nan)  # nulls are dropped first
    df = series({"a": {"x": holes}})
    rho = acf_of(x, 15)
    np.testing.assert_allclose(frame(stats.autocorrelation(df, "x", 15, rows), "lag")["acf"], rho, atol=1e-12)
    partial = frame(stats.partial_autocorrelation(df, "x", 15, rows), "lag")["pacf"].to_numpy()
    for k in (1, 2, 9, 15):  # last coefficient of the Yule-Walker system of order k
        r = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(np.linalg.solve(r, rho[1 : k + 1])[-1] - partial[k]) < 1e-10
    lb = frame(stats.ljung_box(df, "x", 14, rows), "lags").iloc[0]
    q = 300 * 302 * sum(rho[k] ** 2 / (300 - k) for k in range(1, 15))
    assert abs(lb["stat"] - q) < 1e-6 and lb["p_value"] < 1e-12


def test_tails():
    assert abs(P.chi2_tail_value(23.685, 14) - 0.05) < 1e-4
    assert abs(P.chi2_tail_value(11.070, 5) - 0.05) < 1e-4
    assert abs(P.chi2_tail_value(3.841, 1) - 0.05) < 1e-4
    assert abs(P.normal_cdf_value(1.959964) - 0.975) < 1e-6
    assert abs(P.unit_root_p_value(-2.86154) - 0.05) < 2e-3
    assert P.unit_root_p_value(3.0) == 1.0 and P.unit_root_p_value(-20.0) == 0.0


def brute_adf(x, max_lag):
    """The test by explicit design matrices."""
    dx = np.diff(x)

    def fit(lag, start):
        rows = range(start, len(dx))
        design = np.array([[1.0, x[t]] + [dx[t - k] for k in range(1, lag + 1)] for t in rows])
        y = dx[start:]
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        ssr = float(((y - design @ beta) ** 2).sum())
        return design, beta, ssr, len(y)

    def aic(lag):
        _, _, ssr, n = fit(lag, max_lag)
        return n * (math.log(2 * math.pi * ssr / n) + 1) + 2 * (lag + 2)

    lag = min(range(max_lag + 1), key=aic)
    design, beta, ssr, n = fit(lag, lag)
    cov = ssr / (n - lag - 2) * np.linalg.inv(design.T @ design)
    return lag, beta[1] / math.sqrt(cov[1, 1]), n


@pytest.mark.parametrize("rows", [40, 65_536])
def test_unit_root(series, frame, rows):
    walk = 50 + np.cumsum(RNG.normal(0, 1, 250))
    ar = RNG.normal(0, 1, 180)
    for i in range(2, 180):
        ar[i] += 0.5 * ar[i - 1] - 0.3 * ar[i - 2]
    got = frame(tests.adf_test(series({"walk": {"x": walk}, "ar": {"x": ar}}), "x", 12, rows), "nobs").set_index("series_id")
    for key, x in (("walk", walk), ("ar", ar)):
        lag, stat, n = brute_adf(x, 12)
        assert (got.loc[key, "used_lag"], got.loc[key, "nobs"]) == (lag, n)
        assert abs(got.loc[key, "stat"] - stat) < 1e-6
    assert got.loc["walk", "p_value"] > 0.05 > got.loc["ar", "p_value"]
    assert tests.default_lags(2399) == 27


def predictions(spark, series, columns, n):
    df = series({"a": columns})
    parts = [
        df.select("series_id", F.lit(m).alias("model"), "ts", "pos", F.col("y").alias("true"), F.col(m).alias("pred"))
        for m in columns
        if m != "y"
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("norm", [1, 2])
@pytest.mark.parametrize("n", [60, 61])
def test_accuracy_comparison(spark, series, frame, norm, n):
    y = RNG.normal(0, 1, n)
    columns = {"y": y, "m1": y + RNG.normal(0, 1, n), "m2": y + RNG.normal(0, 2, n), "m3": y + 0.5}
    got = tests.dm_test(predictions(spark, series, columns, n), ["m1", "m2", "m3"], norm, 7).toPandas()
    assert len(got) == 3
    for _, row in got.iterrows():
        a, b = (np.abs(y - columns[row[k]]) ** norm for k in ("model_a", "model_b"))
        d = (a - b)[n % 2 :].reshape(-1, 2).mean(axis=1)
        stat = d.mean() / math.sqrt(d.var() / len(d))
        assert abs(row["stat"] - stat) < 1e-9
        assert abs(row["p_a_worse"] - (1 - P.normal_cdf_value(stat))) < 1e-12
        assert row["rows"] == n - n % 2
    verdict = tests.dm_verdict(tests.dm_test(predictions(spark, series, columns, n), ["m3", "m2"], norm)).first()
    assert verdict["better"] == "m3"


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition_finds_the_season(series, frame, model):
    t = np.arange(140)
    season = np.tile([1.0, 2, 3, 0, -1, -2, -3], 20)
    x = 100 + 0.5 * t + season if model == "additive" else (100 + 0.5 * t) * (1 + season / 100)
    got = frame(stats.seasonal_decompose(series({"a": {"x": x}}), "x", 7, model, 32))
    assert got["trend"].isna().sum() == 6
    if model == "additive":
        np.testing.assert_allclose(got["seasonal"], season, atol=1e-9)
        np.testing.assert_allclose(got["resid"].dropna(), 0, atol=1e-9)
    else:
        np.testing.assert_allclose(got["seasonal"], 1 + season / 100, atol=2e-4)


def test_histogram_and_density(series, frame):
    x = np.concatenate([RNG.normal(0, 1, 500), np.full(250, 0.3)])
    df = series({"a": {"x": x}})
    got = frame(stats.histogram(df, "x", 20, 64), "bin")
    counts, edges = np.histogram(x, 20)
    full = np.zeros(20)
    full[got["bin"]] = got["count"]
    np.testing.assert_array_equal(full, counts)
    kde = frame(stats.kernel_density(df, "x", 50, 0.5, 64), "point")
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min() - 0.5 * np.ptp(x), x.max() + 0.5 * np.ptp(x), 50)
    want = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(kde["density"], want, rtol=1e-9)


def test_describe(series, frame):
    x = RNG.normal(10, 2, 101)
    x[3] = np.nan
    got = stats.describe_exact(series({"a": {"x": x}}), ["x"]).first()
    want = pd.Series(x).describe()
    np.testing.assert_allclose(
        [got[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")], want.to_numpy(), rtol=1e-12
    )


def test_quantile_points(series, frame):
    from statistics import NormalDist

    x = RNG.normal(3, 2, 200)
    got = frame(stats.normal_quantile_points(series({"a": {"x": x}}), "x"), "rank")
    z = np.array([NormalDist().inv_cdf(i / 201) for i in range(1, 201)])
    np.testing.assert_allclose(got["theoretical"], z)
    np.testing.assert_allclose(got["sample"], np.sort(x))
    np.testing.assert_allclose(got["line"], x.mean() + x.std() * z)
