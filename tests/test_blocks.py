"""Block size, row order and other series must never change a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ewm, grid, ordered
from barloom.plans import blocks as B

RNG = np.random.default_rng(5)


def values(n, holes=0.0):
    x = np.round(100 + np.cumsum(RNG.normal(0, 1, n)), 4)
    if holes:
        x[RNG.random(n) < holes] = np.nan
    return x


@pytest.fixture(scope="module")
def data():
    return {"a": {"x": values(200, 0.1)}, "b": {"x": values(90, 0.3)}}


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_positions(series, frame, data, rows):
    df = series(data)
    got = frame(B.number_rows(df.withColumnRenamed("pos", "want"), 86400, rows))
    assert (got["pos"] == got["want"]).all()
    kept = df.where("pos % 3 <> 0")
    got = frame(B.renumber(kept.withColumn("old", F.col("pos")), rows))
    for _, part in got.groupby("series_id"):
        assert part["pos"].tolist() == list(range(1, len(part) + 1))
        assert part["old"].is_monotonic_increasing


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_frames(series, frame, data, rows):
    got = frame(
        B.over_blocks(
            series(data),
            lambda t: t.withColumns(
                {
                    "mean": ordered.rolling_mean_of("x", 12),
                    "std": ordered.rolling_std_of("x", 12),
                    "lag": ordered.lagged("x", 5),
                    "lead": F.lead("x", 9).over(B.ordered()),
                }
            ),
            behind=11,
            ahead=9,
            block_rows=rows,
        )
    )
    for key, part in got.groupby("series_id"):
        x = pd.Series(data[key]["x"])
        for column, want in {
            "mean": x.rolling(12).mean(), "std": x.rolling(12).std(), "lag": x.shift(5), "lead": x.shift(-9),
        }.items():
            np.testing.assert_allclose(part[column].to_numpy(dtype=float), want, rtol=1e-9, err_msg=column)


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_carries(series, frame, data, rows):
    df = series(data).withColumn("raw", F.col("x"))
    got = frame(B.accumulate(df, {"total": "raw"}, ["x"], rows))
    for key, part in got.groupby("series_id"):
        x = pd.Series(data[key]["x"])
        np.testing.assert_allclose(part["total"], x.fillna(0).cumsum(), rtol=1e-12)
        np.testing.assert_array_equal(part["x"].to_numpy(dtype=float), x.ffill())


@pytest.mark.parametrize("rows", [1, 7, 512])
def test_interpolation_keeps_head_and_fills_tail(series, frame, rows):
    x = np.array([np.nan, np.nan, 4.0, np.nan, np.nan, np.nan, 8.0, 1.0, np.nan, 3.0, np.nan, np.nan])
    got = frame(grid.interpolate_grid(series({"a": {"x": x}}), ["x"], rows))
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), pd.Series(x).interpolate("linear"))


@pytest.mark.parametrize("rows", [3, 64, 4096])
def test_grid(spark, series, frame, rows):
    df = series({"a": {"x": values(40)}, "b": {"x": values(30)}}, step=60).where("pos % 7 not in (3, 4) and pos not between 12 and 25")
    off = df.where("pos = 5").withColumn("ts", F.col("ts") + F.expr("INTERVAL '20' SECOND"))
    got = frame(grid.fill_grid(df.unionByName(off).drop("pos"), 60, rows))
    base = df.toPandas()
    for key, part in got.groupby("series_id"):
        want = base[base.series_id == key].set_index("ts").sort_index()["x"].asfreq("min")
        np.testing.assert_array_equal(part["x"].to_numpy(dtype=float), want.to_numpy())
        assert part["ts"].tolist() == want.index.tolist()
        assert part["pos"].tolist() == list(range(1, len(want) + 1))


def test_excluded_day_closes_positions(series, frame):
    df = series({"a": {"x": values(100)}, "b": {"x": values(20)}}, step=3600, start=1704067200 + 1800)
    got = frame(grid.exclude_grid_day(df, "2024-01-02", 3600))
    want = frame(B.renumber(grid.exclude_day(df, "2024-01-02")))
    pd.testing.assert_frame_equal(got[["series_id", "ts", "pos"]], want[["series_id", "ts", "pos"]], check_dtype=False)


@pytest.mark.parametrize("rows", [1, 7, 512, 4096])
def test_weighted_means(series, frame, rows):
    x = values(1500, 0.05)
    x[0] = np.nan
    x[700:760] = np.nan
    alphas = {"w": 1 / 14, "f": 2 / 13, "s": 0.2, "steep": 0.9, "flat": 2 / 10_001}
    df = series({"a": {"x": x}, "b": {"x": x[:400]}})
    got = frame(ewm.ewm_mean(df, {k: ("x", a) for k, a in alphas.items()}, rows))
    for key, part in got.groupby("series_id"):
        y = pd.Series(x if key == "a" else x[:400])
        for name, a in alphas.items():
            want = y.ewm(alpha=a, adjust=True, ignore_na=False).mean()
            np.testing.assert_allclose(part[name].to_numpy(dtype=float), want, rtol=1e-11, err_msg=name)


def test_long_spans_copy_no_rows(series, frame, monkeypatch):
    """Every staged table has a row for each given row, however far back the weights reach."""
    staged = []
    monkeypatch.setattr(ewm, "stage", lambda df, name: staged.append(df.count()) or df)
    x = values(3000)
    x[200:2200] = np.nan  # far longer than the steep weights last
    got = frame(ewm.ewm_mean(series({"a": {"x": x}}), {"flat": ("x", 2 / 10_001), "steep": ("x", 0.9)}, 64))
    assert staged == [3000]
    for name, alpha in (("flat", 2 / 10_001), ("steep", 0.9)):
        want = pd.Series(x).ewm(alpha=alpha).mean().ffill()
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want, rtol=1e-11, err_msg=name)


@pytest.mark.parametrize("rows", [5, 300])
def test_macd_and_rsi_by_blocks(series, frame, rows):
    close = pd.Series(100 + np.cumsum(values(700)))
    df = series({"a": {"close": close.to_numpy()}, "b": {"close": close.to_numpy()[:20]}})
    line = close.ewm(span=12).mean() - close.ewm(span=26).mean()
    got = frame(ewm.macd(df, block_rows=rows))
    got = got[got.series_id == "a"]
    np.testing.assert_allclose(got["macd_hist_12_26_9"], line - line.ewm(span=9).mean(), atol=1e-9)
    d = close.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14).mean()
    got = frame(ewm.rsi(df, 14, rows))
    got = got[got.series_id == "a"]["rsi_14"].to_numpy(dtype=float)
    np.testing.assert_allclose(got[5:], (100 - 100 / (1 + up / down)).to_numpy()[5:], rtol=1e-9)


def test_weights_survive_long_flat_stretch(series, frame):
    """Gains and losses decay together for thousands of rows; their ratio must stay."""
    close = np.concatenate([100 + np.sin(np.arange(50)), np.full(4000, 100.5)])
    got = frame(ewm.rsi(series({"a": {"close": close}}), 14, 1024))
    d = pd.Series(close).diff()
    up = d.clip(lower=0).ewm(alpha=1 / 14).mean()
    down = (-d).clip(lower=0).ewm(alpha=1 / 14).mean()
    np.testing.assert_allclose(got["rsi_14"].to_numpy(dtype=float), 100 - 100 / (1 + up / down), rtol=1e-9)


def test_bounded_shares(series, frame):
    df = series({"a": {"close": values(1003)}, "b": {"close": values(57)}})
    for rows in (10, 4096):
        got = frame(ordered.split_by_share(df, block_rows=rows))
        for _, part in got.groupby("series_id"):
            n = len(part)
            sizes = part["split"].value_counts()
            assert sizes["train"] == int(n * 0.8) and sizes["valid"] == int(n * 0.1)
            assert part["split"].tolist() == sorted(part["split"], key=["train", "valid", "test"].index)


def test_last_rows_and_attached_values(series, frame):
    df = series({"a": {"close": values(103)}, "b": {"close": values(9)}})
    got = frame(ordered.last_rows(df, 10))
    assert got.groupby("series_id")["pos"].agg(["min", "max"]).values.tolist() == [[94, 103], [1, 9]]


@pytest.mark.parametrize("rows", [4, 50, 4096])
def test_registry(series, frame, rows):
    """Positions, blocks and lengths come from the registry; it agrees with a count of the rows."""
    df = series({"a": {"close": values(203)}, "b": {"close": values(9)}}).where("pos % 5 <> 3 AND (pos < 40 OR pos > 90)").drop("pos")
    registry = B.register_blocks(df, 86400, rows)
    numbered = B.number_rows(df, 86400, rows, registry)
    pd.testing.assert_frame_equal(frame(numbered), frame(B.number_rows(df, 86400, rows))[numbered.columns])
    blocks = B.with_block(numbered, rows).select("series_id", "_block").distinct()
    found = B.registered_blocks(registry, rows)
    assert found.select("series_id", "_block").exceptAll(blocks).isEmpty() and blocks.count() == found.count()
    ends = registry.groupBy("series_id").agg(F.max("n").alias("n"), F.min("series_first_ts").alias("f"), F.max("last_ts").alias("l"))
    want = numbered.groupBy("series_id").agg(F.max("pos").alias("n"), F.min("ts").alias("f"), F.max("ts").alias("l"))
    assert sorted(ends.collect()) == sorted(want.collect())
    split = ordered.split_by_share(numbered, block_rows=rows, registry=registry)
    pd.testing.assert_frame_equal(frame(split), frame(ordered.split_by_share(numbered, block_rows=rows)))
    per = numbered.groupBy("series_id").agg(F.avg("close").alias("mean"))
    assert B.attach_series(numbered, per, block_rows=rows, registry=registry).count() == numbered.count()


def test_block_numbers_unfold_in_chunks(spark):
    got = B.by_block(spark.createDataFrame([("a", 9000 * 4)], "series_id string, n long"), "n", 4)
    assert sorted(r._block for r in got.collect()) == list(range(9000))
