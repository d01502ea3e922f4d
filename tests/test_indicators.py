import numpy as np
import pandas as pd

from barloom.functions import columns as C
from barloom.operators import ewm, ordered
from barloom.operators.features import drop_incomplete, model_columns, technical_indicators


def ohlc(close, volume=None):
    close = np.asarray(close, dtype=float)
    v = np.full(len(close), 10.0) if volume is None else volume
    return {"open": close, "high": close + 1, "low": close - 1, "close": close, "volume": v}


def test_rsi_edges(series, frame):
    df = series({"up": ohlc(np.arange(1, 41)), "down": ohlc(np.arange(40, 0, -1)), "flat": ohlc(np.full(40, 5.0))})
    got = frame(ewm.rsi(df).withColumn("state", C.rsi_state("rsi_14")))
    last = got[got.pos == 40].set_index("series_id")
    assert last.loc["up", "rsi_14"] == 100 and last.loc["up", "state"] is None
    assert last.loc["down", "rsi_14"] == 0 and last.loc["down", "state"] == "Oversold"
    assert pd.isna(last.loc["flat", "rsi_14"])


def test_volume_balance_is_null_without_move(series, frame):
    close, volume = [1, 2, 2, 1, 3], [10.0, 20, 30, 40, 50]
    for rows in (2, 64):
        got = frame(ordered.on_balance_volume(series({"a": ohlc(close, volume)}), rows))["obv"].tolist()
        assert np.isnan(got[0]) and np.isnan(got[2])
        assert [got[1], got[3], got[4]] == [20, -20, 30]


def test_indicators_against_pandas(series, frame):
    rng = np.random.default_rng(3)
    data = ohlc(100 + np.cumsum(rng.normal(0, 1, 300)))
    small = frame(technical_indicators(series({"a": data}), block_rows=128))
    large = frame(technical_indicators(series({"a": data, "b": ohlc(np.arange(1, 80))})))
    pd.testing.assert_frame_equal(
        small, large[large.series_id == "a"].reset_index(drop=True)[small.columns], check_exact=False, rtol=1e-9
    )
    c = pd.Series(data["close"])
    line = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    np.testing.assert_allclose(small["macd_12_26_9"], line, atol=1e-9)
    np.testing.assert_allclose(small["macd_signal_12_26_9"], line.ewm(span=9).mean(), atol=1e-9)
    h, l, p = c + 1, c - 1, c.shift()
    tr = pd.concat([h - l, (h - p).abs(), (p - l).abs()], axis=1).max(axis=1)
    np.testing.assert_allclose(small["atr_14"].astype(float), tr.rolling(14).mean(), rtol=1e-9)


def test_change_is_null_after_gap_and_pads_holes(series, frame):
    df = series({"a": {"close": [10.0, np.nan, 11.0, 12.0, 6.0]}}, step=60).where("pos <> 4")
    from barloom.plans.blocks import renumber

    got = frame(ordered.gap_aware_change(renumber(df), "close", 60))["pct_change"].tolist()
    assert np.isnan(got[0]) and got[1] == 0.0 and abs(got[2] - 0.1) < 1e-12 and np.isnan(got[3])


def test_signal_and_infinity(spark):
    from pyspark.sql import functions as F

    rows = [(1.01, 1.0, 1.0), (0.99, 1.0, -1.0), (1.001, 1.0, 0.0), (2.0, 0.0, 1.0), (-2.0, 0.0, -1.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "v double, b double, want double")
    assert df.where(C.direction_signal("v", "b") != F.col("want")).count() == 0
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,), (None,)], "x double")
    assert drop_incomplete(odd, ["x"]).collect() == [(1.0,)]


def test_future_labels(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-31 00:00:00' AS ts")
    got = df.select(*[C.future_label("ts", 1, f).alias(f) for f in ("min", "h", "D", "W", "ME")]).first()
    assert list(got) == ["2024-01-31", "2024-01-31", "2024-02-01", "2024-02-07", "2024-02-29"]


def test_model_columns():
    columns = ["series_id", "ts", "pos", "split", "close", "log_close", "log_returns_close", "rsi_14", "rsi_state"]
    assert model_columns(columns) == (["log_returns_close", "rsi_14"], ["rsi_state"])
