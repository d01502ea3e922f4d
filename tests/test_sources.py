import hashlib
from datetime import date

import pytest

from barloom.operators.bars import standardize_bars
from barloom.operators.joins import macro_table, order_grid
from barloom.sources import files


def test_csv_round_trip_and_missing_path(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Timestamp,Open,High,Low,Close,Volume\n1325412060.0,4.58,4.58,4.58,4.58,0.0\n1325412120.5,4.5,5,4,4.6,\n")
    rows = standardize_bars(files.scan_bars(spark, str(path)), "btc").orderBy("timestamp").collect()
    assert str(rows[0].ts) == "2012-01-01 10:01:00" and str(rows[1].ts) == "2012-01-01 10:02:00.500000"
    assert rows[0].series_id == "btc" and rows[1].volume is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_bars(spark, str(tmp_path / "none.csv")).count()


def test_sink_keeps_the_first_write(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 5):
        files.sink_if_absent(spark.range(n), path)
    assert spark.read.csv(path, header=True).count() == 3


def test_checksums(spark, tmp_path):
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta"), ("c.txt", "gamma")):
        (tmp_path / name).write_text(text)
    current = files.file_checksums(spark, str(tmp_path), "*.txt")
    sums = {r.file: r.checksum for r in current.collect()}
    assert sums["a.txt"] == hashlib.sha256(b"alpha").hexdigest()
    registry = spark.createDataFrame([("a.txt", sums["a.txt"]), ("b.txt", "0")], "file string, checksum string")
    status = {r.file: r.status for r in files.verify_checksums(current, registry).collect()}
    assert status == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "missing"}
    assert {r.file for r in files.new_checksums(current, registry).collect()} == {"b.txt", "c.txt"}


def test_files_in_pieces(spark, tmp_path):
    """Large files are streamed; together with the small ones, and beyond the two gigabytes that a row can hold."""
    bodies = {"a.bin": b"x" * 10, "b.bin": bytes(range(256)) * 40_000, "with space.bin": b"y" * 5_000_000, "empty.bin": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.file: (r.bytes, r.checksum) for r in files.file_checksums(spark, str(tmp_path), "*.bin", 1000).collect()}
    assert got == {name: (len(b), hashlib.sha256(b).hexdigest()) for name, b in bodies.items() if b}
    size, digest = (1 << 31) + 12_345, hashlib.sha256()
    with open(tmp_path / "big.zero", "wb") as f:
        f.truncate(size)  # takes no disk
    piece = bytes(1 << 24)
    for _ in range(size >> 24):
        digest.update(piece)
    digest.update(bytes(size & ((1 << 24) - 1)))
    row = files.file_checksums(spark, str(tmp_path), "*.zero").first()
    assert (row.bytes, row.checksum) == (size, digest.hexdigest())


def test_records_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "registry"), "dataset string, checksum string, rows long"
    first = spark.createDataFrame([("d", "c1", 1), ("e", "c/1 %", 2)], schema)
    assert files.record_versions(first, path).count() == 2
    offered = spark.createDataFrame([("d", "c1", 99), ("d", "c2", 3), ("d", "c2", 3)], schema)
    for _ in range(2):  # a rerun adds nothing, and a known version keeps its record
        got = sorted(tuple(r) for r in files.record_versions(offered, path).select("dataset", "checksum", "rows").collect())
        assert got == [("d", "c1", 1), ("d", "c2", 3), ("e", "c/1 %", 2)]
    assert files.read_registry(spark, str(tmp_path / "none"), first.schema).count() == 0
    sums = spark.createDataFrame([("a.txt", 3, "s1")], "file string, bytes long, checksum string")
    log = str(tmp_path / "checksums")
    files.record_checksums(sums, log)
    changed = sums.union(spark.createDataFrame([("a.txt", 4, "s2")], sums.schema))
    assert sorted((r.dataset, r.checksum) for r in files.record_checksums(changed, log).collect()) == [("a.txt", "s1"), ("a.txt", "s2")]


@pytest.mark.parametrize("rows", [3, 65_536])
def test_frequency_of_each_series(spark, rows):
    import pandas as pd
    from pyspark.sql import functions as F

    from barloom.operators.forecasters import naive_forecast
    from barloom.operators.frequency import future_label_by_gap, infer_frequency

    stamps = {
        "m": pd.date_range("2024-01-01", periods=50, freq="min"), "h": pd.date_range("2024-01-01", periods=40, freq="h").delete([3, 4, 9]),
        "d": pd.date_range("2024-01-01", periods=80, freq="D").delete(slice(20, 40)), "w": pd.date_range("2024-01-07", periods=9, freq="W"),
        "me": pd.date_range("2024-01-31", periods=8, freq="ME"), "quarter": pd.date_range("2024-03-31", periods=6, freq="QE"),
        "ten": pd.date_range("2024-01-01", periods=12, freq="10s"), "one": pd.date_range("2024-01-01", periods=1),
    }
    pairs = [(k, str(t)) for k, v in stamps.items() for t in v]
    df = spark.createDataFrame(pairs, "series_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3)
    last = df.groupBy("series_id").agg(F.max("ts").alias("ts"))
    got = {r.series_id: r for r in infer_frequency(df, rows).join(last, "series_id").withColumn("to", future_label_by_gap("ts", 2)).collect()}
    assert {k: r.freq for k, r in got.items()} == {"m": "min", "h": "h", "d": "D", "w": "W", "me": "ME", "quarter": None, "ten": None, "one": None}
    assert got["quarter"].gap_months == 3 and got["quarter"].to == "2025-12-31" and got["me"].to == "2024-10-31"
    assert got["ten"].gap_seconds == 10 and got["one"].to is None and got["w"].to == "2024-03-17"
    bars = df.withColumn("close", F.lit(1.0)).withColumn("pos", F.lit(1).cast("long")).where("series_id = 'me'").dropDuplicates(["series_id", "ts"])
    from barloom.plans.blocks import number_rows

    assert naive_forecast(number_rows(bars.drop("pos"), 86400), 2).first().ts_future == "2024-10-31"


def test_profile_and_versions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS ts, 1.0D AS close UNION ALL SELECT TIMESTAMP_NTZ'2024-01-05', 2.0D")
    row = files.dataset_profile(df, "d", checksum="c1").first()
    assert (str(row.start)[:10], str(row.end)[:10], row.rows, row.columns, row.types["close"]) == ("2024-01-01", "2024-01-05", 2, 2, "double")
    known = spark.createDataFrame([("d", "c1")], "dataset string, checksum string")
    offered = spark.createDataFrame([("d", "c1"), ("d", "c2"), ("d", "c2"), ("e", "c1")], "dataset string, checksum string")
    got = sorted(tuple(r) for r in files.register_versions(offered, known).collect())
    assert got == [("d", "c1"), ("d", "c2"), ("e", "c1")]


def test_macro(spark, tmp_path):
    (tmp_path / "m.csv").write_text("observation_date,M2SL\n1959-01-01,100.0\n1959-02-01,110.0\n1959-03-01,121.0\n1959-04-01,100.0\n")
    supply = files.scan_macro(spark, str(tmp_path / "m.csv"), "M2SL", "m2_supply")
    rate = spark.createDataFrame([(date(1959, m, 1), float(m)) for m in range(1, 6)], "month date, fed_rate double")
    got = {r.month.month: (r.fed_rate, r.m2_supply_mom_pct) for r in macro_table(rate, supply).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == (1.0, None) and got[2] == (2.0, None)
    assert abs(got[3][1] - 10) < 1e-9 and abs(got[4][1] - 10) < 1e-9
    late = {r.month.month: r.fed_rate for r in macro_table(rate, supply, rate_lag_months=1).collect()}
    assert late == {1: None, 2: 1.0, 3: 2.0, 4: 3.0}


def test_order_grid(spark):
    got = [tuple(r) for r in order_grid(spark, [0, 1], [1], [0, 2]).collect()]
    assert sorted(got) == [(0, 1, 0), (0, 1, 2), (1, 1, 0), (1, 1, 2)]


class _Session:
    """Stands in for a session without the setting."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_staging_folder():
    from barloom.plans.staging import shared_folder

    assert shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(_Session("local[2]")) == shared_folder(_Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session("yarn"))


def test_stage_reads_back_the_same(spark):
    from barloom.plans.staging import stage

    df = spark.range(10).selectExpr("id", "cast(id AS string) AS s")
    assert sorted(stage(df, "t").collect()) == sorted(df.collect())
