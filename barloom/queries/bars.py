"""Sources, scalar columns, resampling, grids and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.functions import columns as C
from barloom.operators import bars as B
from barloom.operators import grid, outliers
from barloom.operators.features import drop_incomplete
from barloom.operators.frequency import future_label_by_gap, infer_frequency
from barloom.operators.ordered import lagged
from barloom.plans import tables as T
from barloom.plans.blocks import KEY, TS, epoch_seconds, over_blocks
from barloom.plans.cleaning import clean_bars, clean_raw_bars
from barloom.plans.flows import derived_bars
from barloom.plans.staging import fresh_path, stage
from barloom.queries import sqlparts as S
from barloom.sources import files

EXCLUDED = "2024-01-15"
RAW_SERIES = "purchase"  # the event type whose bars go through cleaning as one raw table


def _raw(spark, sf_dir, freq="h"):
    """Bars in the raw six-column form, epoch seconds first."""
    bars = T.event_bars(spark, sf_dir, freq)
    return bars.select(
        KEY, epoch_seconds(TS).cast("double").alias("timestamp"), *[F.col(c) for c in B.BAR_COLUMNS]
    )


# ------------------------------------------------------------------- sources


@query(
    "scan_bars",
    "timestamp:0 open:4 high:4 low:4 close:4 volume:4",
    f"WITH {S.HOURLY} SELECT CAST(epoch(ts) AS DOUBLE) AS timestamp, open, high, low, close, volume FROM h",
)
def scan_bars(spark, sf_dir):
    path = fresh_path(spark, "raw-bars")
    files.sink_if_absent(_raw(spark, sf_dir).drop(KEY), path, "csv")
    return files.scan_bars(spark, path)


@query(
    "scan_macro_monthly",
    "name month:d value:4",
    f"""WITH {S.MACRO} SELECT 'fed_rate' AS name, month, fed_rate AS value FROM rate
    UNION ALL SELECT 'm2_supply', month, m2_supply FROM supply""",
)
def scan_macro_monthly(spark, sf_dir):
    parts = []
    for name, source, table in (
        ("fed_rate", "FEDFUNDS", T.monthly_rate(spark, sf_dir)),
        ("m2_supply", "M2SL", T.monthly_supply(spark, sf_dir)),
    ):
        path = fresh_path(spark, name)
        files.sink_if_absent(table.select(F.col("month").alias("observation_date"), F.col(name).alias(source)), path)
        read = files.scan_macro(spark, path, source, name)
        parts.append(read.select(F.lit(name).alias("name"), "month", F.col(name).alias("value")))
    return parts[0].unionByName(parts[1])


@query("sink_if_absent", S.BARS, f"WITH {S.DAILY} SELECT * FROM d")
def sink_if_absent(spark, sf_dir):
    """The second write meets an existing table and changes nothing."""
    path = fresh_path(spark, "sink")
    bars = T.daily_bars(spark, sf_dir)
    files.sink_if_absent(bars, path, "parquet")
    files.sink_if_absent(bars.withColumn("close", F.lit(0.0)), path, "parquet")
    return spark.read.schema(bars.schema).parquet(path)


@query("file_checksums", "file bytes:i checksum status")
def file_checksums(spark, sf_dir):
    """Against a registry that lacks one file and has another sum for a second one."""
    current = files.file_checksums(spark, sf_dir, "*.parquet")
    registry = files.new_checksums(current, current.where("false")).where("file <> 'region.parquet'")
    changed = F.when(F.col("file") == "nation.parquet", F.sha2("checksum", 256)).otherwise(F.col("checksum"))
    return files.verify_checksums(current, registry.withColumn("checksum", changed))


@query(
    "dataset_profile",
    "dataset start:t end:t rows:i columns:i close_type",
    f"""WITH {S.HOURLY} SELECT 'hourly_bars' AS dataset, min(ts) AS start, max(ts) AS "end", count(*) AS rows,
    7 AS columns, 'double' AS close_type FROM h""",
)
def dataset_profile(spark, sf_dir):
    profile = files.dataset_profile(T.event_bars(spark, sf_dir, "h"), "hourly_bars")
    return profile.withColumn("close_type", F.col("types")["close"])


@query(
    "register_version",
    "dataset rows:i checksum",
    f"""WITH {S.HOURLY}, {S.MINUTES},
    hv AS (SELECT series_id AS dataset, count(*) AS rows, max(ts) AS mx FROM h GROUP BY 1),
    mv AS (SELECT series_id AS dataset, count(*) AS rows, max(ts) AS mx FROM m GROUP BY 1)
    SELECT dataset, rows, sha256(dataset || '|' || CAST(rows AS VARCHAR)) AS checksum
    FROM (SELECT * FROM hv UNION ALL SELECT * FROM mv) AS v""",
)
def register_version(spark, sf_dir):
    """The registry gets the hourly versions, then twice hourly and minute versions together: each is recorded once."""

    def versions(freq):
        sizes = T.event_bars(spark, sf_dir, freq).groupBy(F.col(KEY).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
        return sizes.withColumn("checksum", F.sha2(F.concat_ws("|", "dataset", F.col("rows").cast("string")), 256))

    path, known = fresh_path(spark, "registry"), versions("h")
    files.record_versions(known, path)
    for _ in range(2):
        registry = files.record_versions(known.unionByName(versions("min")), path)
    return registry


# ------------------------------------------------------------ scalar columns


@query(
    "standardize_bars",
    "ts:t timestamp:0 open:4 high:4 low:4 close:4 volume:4",
    f"WITH {S.MINUTES} SELECT *, CAST(epoch(ts) AS DOUBLE) AS timestamp FROM m",
)
def standardize_bars(spark, sf_dir):
    raw = _raw(spark, sf_dir, "min").drop(KEY).toDF("Timestamp", "Open", "High", "Low", "Close", "Volume")
    return B.standardize_bars(raw)


@query("exclude_day", S.BARS, f"WITH {S.MINUTES} SELECT * FROM m WHERE CAST(ts AS DATE) <> DATE '{EXCLUDED}'")
def exclude_day(spark, sf_dir):
    return grid.exclude_day(T.event_bars(spark, sf_dir, "min"), EXCLUDED)


# The given ticks never have volume 0, so these queries count the trades after the first.
_LESS = "WITH {0}, z AS (SELECT series_id, ts, open, high, low, close, volume - 1 AS volume FROM m_bars)"


def _repeat_volume(spark, sf_dir):
    return T.event_bars(spark, sf_dir, "min").withColumn("volume", F.col("volume") - 1)


@query(
    "flag_zero_volume",
    "series_id ts:t volume:4 is_zero_volume:i",
    _LESS.format(S.MINUTES) + " SELECT *, CASE WHEN volume = 0 THEN 1 ELSE 0 END AS is_zero_volume FROM z",
)
def flag_zero_volume(spark, sf_dir):
    return _repeat_volume(spark, sf_dir).withColumn("is_zero_volume", C.zero_flag("volume"))


@query(
    "range_pct",
    "series_id ts:t range_pct:6",
    f"WITH {S.HOURLY} SELECT *, CASE WHEN open <> 0 THEN (high - low) / open END AS range_pct FROM h",
)
def range_pct(spark, sf_dir):
    return T.event_bars(spark, sf_dir, "h").withColumn("range_pct", C.range_pct())


@query(
    "log_transform",
    "series_id ts:t log_close:6 log1p_volume:6",
    f"WITH {S.HOURLY} SELECT *, CASE WHEN close > 0 THEN ln(close) END AS log_close, ln(1 + volume) AS log1p_volume FROM h",
)
def log_transform(spark, sf_dir):
    bars = T.event_bars(spark, sf_dir, "h")
    return bars.withColumns({"log_close": C.log_value("close"), "log1p_volume": C.log1p_value("volume")})


def _with_infinity(spark, sf_dir):
    per_repeat = F.when(F.col("volume") == 0, F.lit(float("inf"))).otherwise(F.col("close") / F.col("volume"))
    return _repeat_volume(spark, sf_dir).withColumn("per_repeat", per_repeat)


_REPEAT = "CASE WHEN volume <> 0 THEN close / volume END AS per_repeat"


@query("inf_to_null", "series_id ts:t per_repeat:6", _LESS.format(S.MINUTES) + f" SELECT *, {_REPEAT} FROM z")
def inf_to_null(spark, sf_dir):
    return _with_infinity(spark, sf_dir).withColumn("per_repeat", C.finite_or_null("per_repeat"))


@query(
    "drop_incomplete",
    "series_id ts:t close:4 per_repeat:6",
    _LESS.format(S.MINUTES) + f" SELECT *, {_REPEAT} FROM z WHERE volume <> 0",
)
def drop_rows(spark, sf_dir):
    return drop_incomplete(_with_infinity(spark, sf_dir), ["close", "per_repeat"])


@query(
    "integrity_report",
    "series_id negative_prices:i high_less_than_low:i zero_trading_volume:i",
    _LESS.format(S.MINUTES)
    + """ SELECT series_id, count(*) FILTER (open < 0) + count(*) FILTER (high < 0) + count(*) FILTER (low < 0)
    + count(*) FILTER (close < 0) AS negative_prices, count(*) FILTER (high < low) AS high_less_than_low,
    count(*) FILTER (volume = 0) AS zero_trading_volume FROM z GROUP BY series_id""",
)
def integrity(spark, sf_dir):
    return outliers.integrity_report(_repeat_volume(spark, sf_dir))


@query(
    "direction_signal",
    "series_id ts:t close:4 prev:4 sig:1",
    f"""WITH {S.DAILY}, x AS (SELECT *, lag(close) OVER {S.W} AS prev FROM d)
    SELECT *, CASE WHEN prev = 0 THEN sign(close - prev) WHEN (close - prev) / prev > 0.005 THEN 1.0
    WHEN (close - prev) / prev < -0.005 THEN -1.0 ELSE 0.0 END AS sig FROM x WHERE prev IS NOT NULL""",
)
def direction_signal(spark, sf_dir):
    rows = over_blocks(T.daily(spark, sf_dir), lambda t: t.withColumn("prev", lagged("close")), behind=1)
    return rows.where("prev IS NOT NULL").withColumn("sig", C.direction_signal("close", "prev"))


@query(
    "future_timestamp",
    "series_id ts:t in_7_hours in_7_days in_7_weeks in_7_months",
    f"""WITH {S.HOURLY}, x AS (SELECT series_id, max(ts) AS ts FROM h GROUP BY 1)
    SELECT series_id, ts, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS in_7_hours,
    strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS in_7_days, strftime(ts + INTERVAL 49 DAY, '%Y-%m-%d') AS in_7_weeks,
    strftime(last_day(ts + INTERVAL 7 MONTH), '%Y-%m-%d') AS in_7_months FROM x""",
)
def future_timestamp(spark, sf_dir):
    last = T.event_bars(spark, sf_dir, "h").groupBy(KEY).agg(F.max(TS).alias(TS))
    names = {"h": "in_7_hours", "D": "in_7_days", "W": "in_7_weeks", "ME": "in_7_months"}
    return last.withColumns({name: C.future_label(TS, 7, freq) for freq, name in names.items()})


@query(
    "future_timestamp_inferred",
    "series_id freq gap_seconds:i gap_months:i ts_future",
    f"""WITH {S.HOURLY}, {S.DAILY}, me AS (SELECT 'monthly' AS series_id, CAST(last_day(ts) AS TIMESTAMP) AS ts FROM d GROUP BY 2),
    a AS (SELECT series_id, ts FROM h UNION ALL SELECT series_id, ts FROM d UNION ALL SELECT series_id, ts FROM me),
    g AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS b FROM a),
    x AS (SELECT *, CASE WHEN last_day(ts) = ts AND last_day(b) = b THEN date_diff('month', b, ts) ELSE 0 END AS m,
      CAST(epoch(ts) - epoch(b) AS BIGINT) AS s FROM g WHERE b IS NOT NULL),
    c AS (SELECT series_id, CASE WHEN m > 0 THEN 0 ELSE s END AS s, m, count(*) AS c, min(s) AS shortest FROM x GROUP BY 1, 2, 3),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY c DESC, shortest) = 1),
    e AS (SELECT series_id, max(ts) AS ts FROM a GROUP BY 1)
    SELECT k.series_id, CASE WHEN m = 1 THEN 'ME' WHEN m = 0 AND s = 3600 THEN 'h' WHEN m = 0 AND s = 86400 THEN 'D' END AS freq,
      s AS gap_seconds, m AS gap_months, strftime(CASE WHEN m > 0 THEN CAST(last_day(ts + to_months(CAST(7 * m AS INTEGER))) AS TIMESTAMP)
      ELSE ts + to_seconds(7 * s) END, '%Y-%m-%d') AS ts_future FROM k JOIN e ON e.series_id = k.series_id""",
)
def future_timestamp_inferred(spark, sf_dir):
    """Seven bars on for hourly, daily and monthly series whose frequency nobody names."""
    daily = T.daily_bars(spark, sf_dir)
    monthly = B.resample_bars(daily, "ME").withColumn(KEY, F.lit("monthly"))
    bars = [b.select(KEY, TS) for b in (T.event_bars(spark, sf_dir, "h"), daily, monthly)]
    rows = stage(bars[0].union(bars[1]).union(bars[2]), "mixed-bars")
    last = rows.groupBy(KEY).agg(F.max(TS).alias(TS))
    return infer_frequency(rows).join(last, KEY).withColumn("ts_future", future_label_by_gap(TS, 7))


# ---------------------------------------------------------------- resampling

_RESAMPLED = """SELECT series_id, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume FROM m_bars GROUP BY 1, 2"""
_BUCKETS = {
    "hourly": "date_trunc('hour', ts)",
    "daily": "CAST(date_trunc('day', ts) AS TIMESTAMP)",
    "weekly": "CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 6 DAY",
    "monthly": "CAST(last_day(ts) AS TIMESTAMP)",
}


def _resampler(name):
    sql = f"WITH {S.MINUTES} " + _RESAMPLED.format(bucket=_BUCKETS[name])

    @query(f"resample_{name}", S.BARS, sql)
    def run(spark, sf_dir):
        return B.resample_bars(T.event_bars(spark, sf_dir, "min"), B.FREQUENCIES[name])


for _name in B.FREQUENCIES:
    _resampler(_name)


# --------------------------------------------------------------------- grids

_GRID = f"{S.MINUTES}, {S.grid('MINUTE', 'm_bars', 'g')}"


@query("grid_asfreq", S.BARS + " pos:i", f"WITH {_GRID} SELECT * FROM g")
def grid_asfreq(spark, sf_dir):
    return grid.fill_grid(stage(T.event_bars(spark, sf_dir, "min"), "minute-bars"), 60, aligned=True)


# Every 31st minute of an hour comes 30 seconds late.
_LATE = "late_bars AS (SELECT * REPLACE (CASE WHEN minute(ts) = 31 THEN ts + INTERVAL 30 SECOND ELSE ts END AS ts) FROM m_bars)"


@query(
    "grid_off_rows",
    S.BARS + " pos:i",
    f"""WITH {S.MINUTES}, {_LATE}, k_bars AS (SELECT late_bars.* FROM late_bars JOIN (SELECT series_id, min(ts) AS st FROM late_bars GROUP BY 1) AS f
      ON f.series_id = late_bars.series_id WHERE CAST(epoch(ts) - epoch(st) AS BIGINT) % 60 = 0), {S.grid('MINUTE', 'k_bars', 'g')} SELECT * FROM g""",
)
def grid_off_rows(spark, sf_dir):
    """Rows that lie between the steps of the grid are left out."""
    late = F.when(F.minute(TS) == 31, F.col(TS) + F.expr("INTERVAL '30' SECOND")).otherwise(F.col(TS))
    return grid.fill_grid(stage(T.event_bars(spark, sf_dir, "min").withColumn(TS, late), "late-bars"), 60)


@query(
    "missing_share",
    "series_id rows:i missing:i missing_pct:6",
    f"""WITH {_GRID} SELECT series_id, count(*) AS rows, count(*) FILTER (close IS NULL) AS missing,
    count(*) FILTER (close IS NULL) / count(*) * 100 AS missing_pct FROM g GROUP BY 1""",
)
def missing_share(spark, sf_dir):
    return grid.missing_share(grid.fill_grid(stage(T.event_bars(spark, sf_dir, "min"), "minute-bars"), 60, aligned=True))


def _interpolated(c: str) -> str:
    before = f"last_value(CASE WHEN {c} IS NOT NULL THEN {{0}} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    after = before.replace("ORDER BY pos", "ORDER BY pos DESC")
    p0, v0, p1, v1 = before.format("pos"), before.format(c), after.format("pos"), after.format(c)
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {p1} IS NULL THEN {v0} ELSE {v0} + ({v1} - {v0}) * ((pos - {p0}) / ({p1} - {p0})) END AS {c}"


@query(
    "interpolate_linear",
    S.BARS.replace(":4", ":10"),
    f"WITH {_GRID} SELECT series_id, ts, pos, {', '.join(_interpolated(c) for c in B.BAR_COLUMNS)} FROM g",
)
def interpolate_linear(spark, sf_dir):
    return grid.fill_gaps(stage(T.event_bars(spark, sf_dir, "min"), "minute-bars"), 60, B.BAR_COLUMNS, aligned=True)


# ------------------------------------------------------------------ outliers

# The grid without the excluded day, numbered again, with change and spread.
_DERIVED = f"""{_GRID},
k AS (SELECT series_id, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos
  FROM g WHERE CAST(ts AS DATE) <> DATE '{EXCLUDED}'),
k1 AS (SELECT *, {S.ffill('close')} AS pad FROM k),
k2 AS (SELECT *, CASE WHEN volume = 0 THEN 1 ELSE 0 END AS is_zero_volume,
  CASE WHEN open <> 0 THEN (high - low) / open END AS intra_minute_spread,
  CASE WHEN ts - lag(ts) OVER {S.W} <= INTERVAL 1 MINUTE AND lag(pad) OVER {S.W} <> 0
    THEN pad / lag(pad) OVER {S.W} - 1 END AS pct_change,
  lag(close) OVER {S.W} AS c0, lead(close) OVER {S.W} AS c1, count(*) OVER (PARTITION BY series_id) AS n FROM k1),
t AS (SELECT series_id, quantile_cont(abs(pct_change), 0.9999) AS pct_change_threshold,
  quantile_cont(abs(intra_minute_spread), 0.9999) AS spread_threshold,
  quantile_cont(volume, 0.05) FILTER (volume > 0) AS volume_threshold FROM k2 GROUP BY 1),
cand AS (SELECT k2.*, pct_change_threshold, spread_threshold, volume_threshold FROM k2 JOIN t ON t.series_id = k2.series_id
  WHERE abs(pct_change) > pct_change_threshold OR abs(intra_minute_spread) > spread_threshold),
cls AS (SELECT *, CASE WHEN rev AND lowv THEN 'High Confidence Error' WHEN rev THEN 'Likely Error'
  WHEN lowv THEN 'Suspicious' ELSE 'Possible Real Market Event' END AS classification
  FROM (SELECT *, coalesce(CASE WHEN abs(close - c0) > 0 THEN abs(close - c1) / abs(close - c0) > 0.75 ELSE false END, false) AS rev,
    coalesce(volume = 0 OR volume < volume_threshold, false) AS lowv FROM cand WHERE pos > 1 AND pos < n) AS y)"""
_DERIVED_SPEC = S.BARS + " is_zero_volume:i pct_change:6 intra_minute_spread:6"


def _derived(spark, sf_dir):
    bars = stage(T.event_bars(spark, sf_dir, "min"), "minute-bars")
    return stage(derived_bars(bars, 60, EXCLUDED, aligned=True), "derived-bars")


@query("pct_change_gap_aware", "series_id ts:t close:4 pct_change:6", f"WITH {_DERIVED} SELECT * FROM k2")
def pct_change_gap_aware(spark, sf_dir):
    return derived_bars(stage(T.event_bars(spark, sf_dir, "min"), "minute-bars"), 60, EXCLUDED, aligned=True)


@query(
    "outlier_thresholds",
    "series_id pct_change_threshold:6 spread_threshold:6 volume_threshold:6",
    f"WITH {_DERIVED} SELECT * FROM t",
)
def outlier_thresholds(spark, sf_dir):
    return outliers.outlier_thresholds(_derived(spark, sf_dir))


@query("outlier_candidates", "series_id ts:t pct_change:6 intra_minute_spread:6", f"WITH {_DERIVED} SELECT * FROM cand")
def outlier_candidates(spark, sf_dir):
    derived = _derived(spark, sf_dir)
    return outliers.outlier_candidates(derived, outliers.outlier_thresholds(derived))


@query("outlier_classify", "series_id ts:t close:4 volume:4 classification", f"WITH {_DERIVED} SELECT * FROM cls")
def outlier_classify(spark, sf_dir):
    derived = _derived(spark, sf_dir)
    return outliers.classify_outliers(derived, outliers.outlier_thresholds(derived))


_REPAIRED = f"""{_DERIVED},
w AS (SELECT k2.* EXCLUDE (open, high, low, close, volume), {', '.join(
    f"CASE WHEN cls.series_id IS NULL THEN k2.{c} END AS {c}" for c in B.BAR_COLUMNS)}
  FROM k2 LEFT JOIN (SELECT series_id, pos FROM cls WHERE classification IN ('High Confidence Error', 'Likely Error')) AS cls
  ON cls.series_id = k2.series_id AND cls.pos = k2.pos),
r AS (SELECT series_id, ts, pos, is_zero_volume, pct_change, intra_minute_spread,
  {', '.join(f"{S.ffill(c)} AS {c}" for c in B.BAR_COLUMNS)} FROM w)"""


@query("outlier_impute", S.BARS, f"WITH {_REPAIRED} SELECT * FROM r")
def outlier_impute(spark, sf_dir):
    derived = _derived(spark, sf_dir)
    classified = outliers.classify_outliers(derived, outliers.outlier_thresholds(derived))
    return outliers.impute_outliers(derived, classified)


@query("clean_bars", _DERIVED_SPEC, f"WITH {_REPAIRED} SELECT * FROM r")
def clean(spark, sf_dir):
    return clean_bars(stage(T.event_bars(spark, sf_dir, "min"), "minute-bars"), 60, EXCLUDED, aligned=True)


def _raw_minutes(spark, sf_dir):
    """Minute bars of one event type in the raw six-column form."""
    return _raw(spark, sf_dir, "min").where(F.col(KEY) == RAW_SERIES).drop(KEY)


@query("clean_raw_bars", _DERIVED_SPEC, f"WITH {_REPAIRED} SELECT * FROM r WHERE series_id = '{RAW_SERIES}'")
def clean_raw(spark, sf_dir):
    return clean_raw_bars(_raw_minutes(spark, sf_dir), RAW_SERIES, 60, EXCLUDED, aligned=True)[0]


@query(
    "clean_raw_report",
    "series_id negative_prices:i high_less_than_low:i zero_trading_volume:i",
    f"""WITH {S.MINUTES} SELECT series_id, count(*) FILTER (open < 0) + count(*) FILTER (high < 0) + count(*) FILTER (low < 0)
    + count(*) FILTER (close < 0) AS negative_prices, count(*) FILTER (high < low) AS high_less_than_low,
    count(*) FILTER (volume = 0) AS zero_trading_volume FROM m WHERE series_id = '{RAW_SERIES}' GROUP BY 1""",
)
def clean_raw_report(spark, sf_dir):
    return clean_raw_bars(_raw_minutes(spark, sf_dir), RAW_SERIES, 60, EXCLUDED, aligned=True)[1]
