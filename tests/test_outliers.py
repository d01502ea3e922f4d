import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, outliers
from barloom.plans import flows
from barloom.plans.cleaning import clean_bars

LOW, HIGH = 1.0, 100.0


def minute_bars(close, volume):
    close = np.asarray(close, dtype=float)
    return {
        "open": close, "high": close, "low": close, "close": close, "volume": np.asarray(volume, dtype=float),
        "pct_change": pd.Series(close).pct_change(fill_method=None).to_numpy(), "intra_minute_spread": np.zeros(len(close)),
    }


@pytest.mark.parametrize("rows", [2, 512])
def test_four_classes(series, frame, rows):
    spike, step = [10, 10, 20, 10, 10, 10], [10, 10, 20, 20, 20, 20]
    data = {
        "high": minute_bars(spike, [50, 50, LOW, 50, 50, 50]),
        "likely": minute_bars(spike, [50, 50, HIGH, 50, 50, 50]),
        "suspicious": minute_bars(step, [50, 50, LOW, 50, 50, 50]),
        "event": minute_bars(step, [50, 50, HIGH, 50, 50, 50]),
        "ends": minute_bars([20, 10, 10, 10, 10, 20], [50] * 6),
    }
    df = series(data, step=60)
    limits = df.groupBy("series_id").agg(F.max("pos").alias("n")).withColumns(
        {"pct_change_threshold": F.lit(0.6), "spread_threshold": F.lit(0.5), "volume_threshold": F.lit(5.0)}
    )
    classes = outliers.classify_outliers(df, limits, rows)
    got = frame(classes).groupby("series_id")[["pos", "classification"]].agg(list)
    assert got.loc["high"].tolist() == [[3], [outliers.HIGH_CONFIDENCE]]
    assert got.loc["likely"].tolist() == [[3], [outliers.LIKELY]]
    assert got.loc["suspicious"].tolist() == [[3], [outliers.SUSPICIOUS]]
    assert got.loc["event"].tolist() == [[3], [outliers.REAL_EVENT]]
    assert "ends" not in got.index  # first and last row are skipped
    fixed = frame(outliers.impute_outliers(df, classes, rows)).groupby("series_id")["close"].agg(list)
    assert fixed["high"] == fixed["likely"] == [10] * 6
    assert fixed["suspicious"] == fixed["event"] == [float(v) for v in step]


def test_cleaning_against_pandas(series, frame):
    rng = np.random.default_rng(9)
    n = 4000
    close = np.round(100 + np.cumsum(rng.normal(0, 0.02, n)), 4)
    close[1500] *= 1.5
    volume = rng.integers(1, 100, n).astype(float)
    data = {"open": close, "high": close + 0.1, "low": close - 0.1, "close": close, "volume": volume}
    df = series({"a": data}, step=60).where("pos not between 700 and 720")
    got = frame(clean_bars(df.drop("pos"), 60, "2024-01-02", block_rows=512))

    p = df.toPandas().sort_values("ts").set_index("ts")[bars.BAR_COLUMNS].asfreq("min")
    p = p[p.index.date != pd.Timestamp("2024-01-02").date()].copy()
    p["pct"] = p["close"].ffill().pct_change()
    p.loc[p.index.to_series().diff().dt.total_seconds() > 60, "pct"] = np.nan
    p["spread"] = (p["high"] - p["low"]) / p["open"]
    np.testing.assert_allclose(got["pct_change"].astype(float), p["pct"], rtol=1e-9, atol=1e-15)
    t1, t2 = p["pct"].abs().quantile(0.9999), p["spread"].abs().quantile(0.9999)
    t3 = p["volume"][p["volume"] > 0].quantile(0.05)
    wrong = []
    for i in range(1, len(p) - 1):
        if not (abs(p["pct"].iloc[i]) > t1 or abs(p["spread"].iloc[i]) > t2):
            continue
        c = p["close"].iloc[i - 1 : i + 2].to_numpy()
        up = abs(c[1] - c[0])
        if up > 0 and abs(c[1] - c[2]) / up > 0.75:
            wrong.append(i)
    p.iloc[wrong, :5] = np.nan
    p[bars.BAR_COLUMNS] = p[bars.BAR_COLUMNS].ffill()
    assert wrong and t3 > 0
    for c in bars.BAR_COLUMNS:
        np.testing.assert_allclose(got[c].astype(float), p[c], rtol=1e-12)


def in_steps(df, step, day, rows):
    """The same cleaning as separate operators."""
    derived = flows.derived_bars(df, step, day, rows)
    return outliers.impute_outliers(derived, outliers.classify_outliers(derived, outliers.outlier_thresholds(derived, rows), rows), rows)


@pytest.mark.parametrize(("rows", "day"), [(7, "2024-01-02"), (512, "2024-01-02"), (20, None), (20, "2024-01-04"), (20, "2023-12-31"), (3, "2024-01-01")])
def test_fused_cleaning_equals_its_steps(series, frame, rows, day):
    """Series that begin, end or lie in the removed day, gaps of any length around it, null bars, rows off the grid."""
    rng = np.random.default_rng(21)
    step = 3600

    def bars_of(n, nulls=0.1):
        close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 3)
        close[rng.random(n) < 0.03] *= 1.7
        close[rng.random(n) < nulls] = np.nan
        return {"open": close, "high": close + 1, "low": close - 1, "close": close, "volume": rng.integers(0, 4, n).astype(float)}

    df = series({"all": bars_of(90), "short": bars_of(30, 0), "one": bars_of(1, 0)}, step=step)
    gappy = df.where("NOT (series_id = 'all' AND (pos BETWEEN 20 AND 30 OR pos BETWEEN 47 AND 49 OR pos IN (55, 70)))")
    late = df.where("series_id = 'all' AND pos > 28").withColumn("series_id", F.lit("begins inside"))
    early = df.where("series_id = 'all' AND pos < 40").withColumn("series_id", F.lit("ends inside"))
    within = df.where("series_id = 'all' AND pos BETWEEN 27 AND 45").withColumn("series_id", F.lit("inside"))
    off = df.where("series_id = 'short' AND pos = 5").withColumn("ts", F.col("ts") + F.expr("INTERVAL '7' MINUTE"))
    table = gappy.union(late).union(early).union(within).union(off).drop("pos")
    want = frame(in_steps(table, step, day, rows))
    got = frame(clean_bars(table, step, day, rows))
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got[want.columns].astype({"pos": int}), want.astype({"pos": int}), rtol=1e-12)


def test_raw_table_to_clean_bars(spark, frame):
    from barloom.plans.cleaning import clean_raw_bars

    raw = [(1704067200.0 + 60 * i, 10.0, 9.0 if i == 3 else 11.0, 10.0, 10.0 + i % 2, 0.0 if i == 5 else 1.0) for i in range(50) if i != 20]
    df = spark.createDataFrame(raw, "Timestamp double, Open double, High double, Low double, Close double, Volume double")
    clean, report = clean_raw_bars(df, "x")
    assert clean.count() == 50 and clean.where("is_zero_volume = 1").count() == 1
    assert tuple(report.first()) == ("x", 0, 1, 1)


def test_integrity_report(spark):
    rows = [("a", -1.0, 1.0, 2.0, 1.0, 0.0), ("a", 1.0, 3.0, 2.0, -1.0, 5.0)]
    df = spark.createDataFrame(rows, "series_id string, open double, high double, low double, close double, volume double")
    assert tuple(outliers.integrity_report(df).first()) == ("a", 2, 1, 1)


def test_resampling_labels_and_nulls(spark):
    rows = [
        ("a", "2024-01-31 23:59:00", 1.0, 2.0, 0.5, 1.5, 10.0), ("a", "2024-02-04 12:00:00", None, 3.0, 1.0, None, None),
        ("a", "2024-02-04 12:01:00", 2.0, 4.0, 1.0, 3.0, 5.0), ("a", "2024-02-05 00:00:00", 7.0, 8.0, 6.0, 7.5, 1.0),
        ("a", "2024-03-01 00:00:00", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "series_id string, ts string, open double, high double, low double, close double, volume double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    week = {str(r.ts)[:10]: tuple(r)[2:] for r in bars.resample_bars(df, "W").collect()}
    assert week == {"2024-02-04": (1.0, 4.0, 0.5, 3.0, 15.0), "2024-02-11": (7.0, 8.0, 6.0, 7.5, 1.0)}
    month = {str(r.ts)[:10]: tuple(r)[2:] for r in bars.resample_bars(df, "ME").collect()}
    assert month == {"2024-01-31": (1.0, 2.0, 0.5, 1.5, 10.0), "2024-02-29": (2.0, 8.0, 1.0, 7.5, 6.0)}
    assert set(bars.resample_all(df)) == {"hourly", "daily", "weekly", "monthly"}
