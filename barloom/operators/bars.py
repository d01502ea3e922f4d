"""Bars: standard form, aggregation of ticks, change of frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import KEY, TS, epoch_seconds, from_epoch

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
FREQUENCIES = {"hourly": "h", "daily": "D", "weekly": "W", "monthly": "ME"}
_SECONDS = {"min": 60, "h": 3600, "D": 86400}

# Shortest distance between two bars of a frequency, for block widths.
STEP_SECONDS = {**_SECONDS, "W": 7 * 86400, "ME": 28 * 86400}


def bucket(ts: Column | str, freq: str) -> Column:
    """Label of the bar a timestamp falls in.  Weeks end on Sunday and months on their
    last day, and carry that day as label."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq in _SECONDS:
        seconds = epoch_seconds(c)
        return from_epoch(seconds - F.pmod(seconds, F.lit(_SECONDS[freq])))
    if freq == "W":
        return F.date_add(F.trunc(F.to_date(c), "week"), 6).cast("timestamp_ntz")
    if freq == "ME":
        return F.last_day(F.to_date(c)).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def standardize_bars(df: DataFrame, series: str | None = None) -> DataFrame:
    """Rename six columns by position and turn epoch seconds into ``ts``."""
    named = df.toDF("timestamp", *BAR_COLUMNS)
    ts = from_epoch(F.col("timestamp"))
    key = [F.lit(series).alias(KEY)] if series else []
    return named.select(*key, ts.alias(TS), "timestamp", *BAR_COLUMNS)


def ticks_to_bars(df: DataFrame, series: Column, ts: Column, price: Column, order: Column, freq: str) -> DataFrame:
    """Aggregate price records to bars; volume is the number of records.

    All five aggregates combine on the map side, so a hot series costs no skew.
    """
    ticks = df.select(series.alias(KEY), bucket(ts, freq).alias(TS), price.alias("p"), order.alias("o"))
    return ticks.groupBy(KEY, TS).agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def resample_bars(df: DataFrame, freq: str) -> DataFrame:
    """First / max / min / last / sum per bucket; buckets without a price are dropped."""
    named = df.select(KEY, F.col(TS).alias("_t"), bucket(TS, freq).alias("_b"), *BAR_COLUMNS)
    return (
        named.groupBy(KEY, F.col("_b").alias(TS))
        .agg(
            F.expr("min_by(open, _t) FILTER (WHERE open IS NOT NULL)").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.expr("max_by(close, _t) FILTER (WHERE close IS NOT NULL)").alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        )
        .na.drop(subset=BAR_COLUMNS)
    )


def resample_all(df: DataFrame) -> dict[str, DataFrame]:
    """Hourly, daily, weekly and monthly bars by name."""
    return {name: resample_bars(df, freq) for name, freq in FREQUENCIES.items()}
