"""Ordered-window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.operators import ewm, grid, ordered
from barloom.operators.bars import BAR_COLUMNS
from barloom.operators.joins import macro_table
from barloom.plans import tables as T
from barloom.plans.blocks import KEY, POS, TS, fill_forward, over_blocks
from barloom.plans.staging import stage
from barloom.queries import sqlparts as S

_HGRID = f"{S.HOURLY}, {S.grid('HOUR', 'h_bars', 'g')}"


def _hour_grid(spark, sf_dir):
    """Hourly grid with holes, staged: carries read it twice."""
    return stage(grid.fill_grid(T.event_bars(spark, sf_dir, "h"), 3600, aligned=True), "hour-grid")


_RETURNS = " ".join(f"log_{c}:6 log_returns_{c}:6" for c in ("open", "close", "volume"))


@query(
    "log_returns",
    f"series_id ts:t {_RETURNS}",
    f"WITH {S.DAILY} SELECT *, "
    + ", ".join(f"ln({c}) AS log_{c}, ln({c}) - lag(ln({c})) OVER {S.W} AS log_returns_{c}" for c in ("open", "close", "volume"))
    + " FROM d",
)
def log_returns(spark, sf_dir):
    return ordered.log_returns(T.daily(spark, sf_dir), ["open", "close", "volume"])


@query("lag_shift", "series_id ts:t close:4 lag_7:4", f"WITH {S.HOURLY} SELECT *, lag(close, 7) OVER {S.W} AS lag_7 FROM h")
def lag_shift(spark, sf_dir):
    h = T.hourly(spark, sf_dir).select(KEY, TS, POS, "close")
    return over_blocks(h, lambda t: t.withColumn("lag_7", ordered.lagged("close", 7)), behind=7)


@query("diff_h", "series_id ts:t close:4 diff_7:4", f"WITH {S.HOURLY} SELECT *, close - lag(close, 7) OVER {S.W} AS diff_7 FROM h")
def diff_h(spark, sf_dir):
    h = T.hourly(spark, sf_dir).select(KEY, TS, POS, "close")
    return over_blocks(h, lambda t: t.withColumn("diff_7", ordered.difference("close", 7)), behind=7)


@query(
    "forward_fill",
    S.BARS,
    f"WITH {_HGRID} SELECT series_id, ts, pos, {', '.join(f'{S.ffill(c)} AS {c}' for c in BAR_COLUMNS)} FROM g",
)
def forward_fill(spark, sf_dir):
    return fill_forward(_hour_grid(spark, sf_dir), BAR_COLUMNS)


@query("fill_zero", "series_id ts:t volume:4", f"WITH {_HGRID} SELECT series_id, ts, coalesce(volume, 0) AS volume FROM g")
def fill_zero(spark, sf_dir):
    return _hour_grid(spark, sf_dir).na.fill(0.0, subset=["volume"])


@query("rolling_mean", "series_id ts:t close:4 sma_50:4", f"WITH {S.DAILY} SELECT *, {S.roll('avg', 'close', 50)} AS sma_50 FROM d")
def rolling_mean(spark, sf_dir):
    return ordered.rolling_mean(T.daily(spark, sf_dir), {"sma_50": ("close", 50)})


@query(
    "rolling_std",
    "series_id ts:t close:4 std_30:4",
    f"WITH {_HGRID} SELECT *, {S.roll('stddev_samp', 'close', 30)} AS std_30 FROM g",
)
def rolling_std(spark, sf_dir):
    return ordered.rolling_std(_hour_grid(spark, sf_dir), {"std_30": ("close", 30)})


@query(
    "annualized_volatility",
    "series_id ts:t log_return:6 rolling_volatility:6",
    f"""WITH {S.DAILY}, x AS (SELECT *, ln(close) - lag(ln(close)) OVER {S.W} AS log_return FROM d)
    SELECT *, {S.roll('stddev_samp', 'log_return', 30)} * sqrt(365) AS rolling_volatility FROM x""",
)
def annualized_volatility(spark, sf_dir):
    return ordered.annualized_volatility(T.daily(spark, sf_dir))


@query(
    "ewm_mean",
    "series_id ts:t close:4 wilder_14:6 span_12:6 span_9:6",
    f"""WITH {_HGRID} SELECT *, {S.ewm('close', 1 / 14)} AS wilder_14, {S.ewm('close', 2 / 13)} AS span_12,
    {S.ewm('close', 0.2)} AS span_9 FROM g""",
)
def ewm_mean(spark, sf_dir):
    """On the grid with its holes: nulls are skipped but count as steps."""
    return ewm.ewm_mean(
        _hour_grid(spark, sf_dir),
        {"wilder_14": ("close", 1 / 14), "span_12": ("close", 2 / 13), "span_9": ("close", 0.2)},
    )


_MOVES = f"""{S.DAILY},
a AS (SELECT *, close - lag(close) OVER {S.W} AS move,
  greatest(high - low, abs(high - lag(close) OVER {S.W}), abs(lag(close) OVER {S.W} - low)) AS tr FROM d),
b AS (SELECT *, CASE WHEN move > 0 THEN move WHEN move <= 0 THEN 0.0 END AS gain,
  CASE WHEN move < 0 THEN -move WHEN move >= 0 THEN 0.0 END AS loss,
  CASE WHEN move > 0 THEN volume WHEN move < 0 THEN -volume END AS signed FROM a),
c AS (SELECT *, {S.ewm('gain', 1 / 14)} AS up, {S.ewm('loss', 1 / 14)} AS down FROM b)"""


@query(
    "rsi_14",
    "series_id ts:t close:4 rsi_14:6",
    f"""WITH {_MOVES} SELECT *, CASE WHEN down = 0 AND up > 0 THEN 100.0 WHEN down > 0 THEN 100 - 100 / (1 + up / down) END
    AS rsi_14 FROM c""",
)
def rsi_14(spark, sf_dir):
    return ewm.rsi(T.daily(spark, sf_dir))


@query("atr_14", "series_id ts:t close:4 atr_14:4", f"WITH {_MOVES} SELECT *, {S.roll('avg', 'tr', 14)} AS atr_14 FROM c")
def atr_14(spark, sf_dir):
    return ordered.average_true_range(T.daily(spark, sf_dir))


@query(
    "obv",
    "series_id ts:t close:4 obv:4",
    f"WITH {_MOVES} SELECT *, CASE WHEN signed IS NOT NULL THEN sum(signed) OVER {S.W} END AS obv FROM c",
)
def obv(spark, sf_dir):
    return ordered.on_balance_volume(stage(T.daily(spark, sf_dir), "daily"))


@query(
    "macd_12_26_9",
    "series_id ts:t close:4 macd_12_26_9:3 macd_signal_12_26_9:3 macd_hist_12_26_9:3",
    f"""WITH {S.DAILY}, a AS (SELECT *, {S.ewm('close', 2 / 13)} - {S.ewm('close', 2 / 27)} AS macd_12_26_9 FROM d),
    b AS (SELECT *, {S.ewm('macd_12_26_9', 0.2)} AS macd_signal_12_26_9 FROM a)
    SELECT *, macd_12_26_9 - macd_signal_12_26_9 AS macd_hist_12_26_9 FROM b""",
)
def macd(spark, sf_dir):
    return ewm.macd(T.daily(spark, sf_dir))


@query("mom_pct_lagged", "month:d m2_supply_mom_pct:6", f"WITH {S.MACRO} SELECT * FROM macro")
def mom_pct_lagged(spark, sf_dir):
    return macro_table(T.monthly_rate(spark, sf_dir), T.monthly_supply(spark, sf_dir))


@query(
    "topk_volume_spikes",
    "series_id ts:t close:4 volume:4",
    f"WITH {S.MINUTES} SELECT * FROM m ORDER BY volume DESC, series_id, ts LIMIT 10",
)
def topk_volume_spikes(spark, sf_dir):
    return ordered.top_rows(T.event_bars(spark, sf_dir, "min"))


@query(
    "last_window",
    "series_id ts:t pos:i close:4",
    f"WITH {S.HOURLY} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM h) AS x WHERE pos > n - 30",
)
def last_window(spark, sf_dir):
    return ordered.last_rows(T.hourly(spark, sf_dir), 30)


@query("time_split", "series_id ts:t pos:i split", f"WITH {S.DAILY_SPLIT} SELECT * FROM s")
def time_split(spark, sf_dir):
    rows, registry = T.numbered_with_registry(T.daily_bars(spark, sf_dir), "D")
    return ordered.split_by_share(rows, registry=registry)


@query(
    "boundary_split",
    "series_id ts:t split log_return:6",
    f"""WITH {S.DAILY_SPLIT}, x AS (SELECT *, ln(close) - lag(ln(close)) OVER {S.W} AS log_return FROM s)
    SELECT * FROM x WHERE log_return IS NOT NULL""",
)
def boundary_split(spark, sf_dir):
    """Bounds saved from the split of the bars, applied to a derived table that lost its head."""
    bars = T.daily_split(spark, sf_dir)
    derived = ordered.annualized_volatility(bars.drop("split")).where(F.col("log_return").isNotNull())
    return ordered.split_at_bounds(derived, ordered.split_bounds(bars))


@query(
    "stationarity_table",
    "series_id ts:t close:4 rolling_mean:4 rolling_std:4",
    f"""WITH {S.DAILY} SELECT *, {S.roll('avg', 'close', 30)} AS rolling_mean,
    {S.roll('stddev_samp', 'close', 30)} AS rolling_std FROM d""",
)
def stationarity_table(spark, sf_dir):
    return ordered.stationarity_table(T.daily(spark, sf_dir))


@query(
    "lag_diff_table",
    "series_id ts:t close:4 lag_30:4 diff_30:4",
    f"WITH {S.DAILY} SELECT *, lag(close, 30) OVER {S.W} AS lag_30, close - lag(close, 30) OVER {S.W} AS diff_30 FROM d",
)
def lag_diff_table(spark, sf_dir):
    return ordered.lag_and_diff(T.daily(spark, sf_dir), "close", 30)


@query(
    "trend_table",
    "series_id ts:t close:4 volume:4 close_ma_50:6 close_ma_200:6 volume_ma_30:6 volume_ma_50:6 volume_ma_200:6",
    f"WITH {S.DAILY} SELECT *, {S.roll('avg', 'close', 50)} AS close_ma_50, {S.roll('avg', 'close', 200)} AS close_ma_200, "
    + ", ".join(f"{S.roll('avg', 'volume', n)} AS volume_ma_{n}" for n in (30, 50, 200))
    + " FROM d",
)
def trend_table(spark, sf_dir):
    return ordered.trend_table(T.daily(spark, sf_dir))

