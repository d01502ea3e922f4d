"""The frequency of a series from its own timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import BLOCK_ROWS, KEY, TIME_BLOCK, TS, epoch_seconds

# Names of the gaps that bars of a fixed frequency have.
FREQ_NAMES = {60: "min", 3600: "h", 86400: "D", 7 * 86400: "W"}
MONTH_END = "ME"


def _gaps(df: DataFrame, block_rows: int) -> DataFrame:
    """``(series_id, seconds, months)`` from each row to the next of its series; ``months`` only between ends of months.

    Rows are placed in time blocks as wide as the densest series needs for ``block_rows`` rows, so a long series is many tasks;
    the row before a block comes from the ends of blocks.
    """
    rows = df.select(KEY, TS).where(F.col(TS).isNotNull())
    span = epoch_seconds(F.max(TS)) - epoch_seconds(F.min(TS))
    densest = rows.groupBy(KEY).agg((span / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("mean"))
    step = densest.where("mean > 0").agg(F.min("mean")).first()[0] or 1.0  # one number
    block = F.floor(epoch_seconds(TS) / F.lit(max(1.0, step * block_rows)))
    tagged = rows.withColumn(TIME_BLOCK, block)
    ends = tagged.groupBy(KEY, TIME_BLOCK).agg(F.max(TS).alias("_end"))
    before = ends.select(KEY, TIME_BLOCK, F.lag("_end").over(Window.partitionBy(KEY).orderBy(TIME_BLOCK)).alias("_before"))
    inside = Window.partitionBy(KEY, TIME_BLOCK).orderBy(TS)
    pairs = tagged.join(before, [KEY, TIME_BLOCK]).withColumn("_prev", F.coalesce(F.lag(TS).over(inside), "_before"))
    seconds = epoch_seconds(TS) - epoch_seconds("_prev")

    def month_end(c: str) -> Column:
        return (F.last_day(F.to_date(c)) == F.to_date(c)) & (F.col(c) == F.to_date(c).cast("timestamp_ntz"))

    def month(c: str) -> Column:
        return F.year(c) * 12 + F.month(c)

    months = F.when(month_end(TS) & month_end("_prev"), month(TS) - month("_prev"))
    return pairs.where(seconds > 0).select(KEY, seconds.alias("seconds"), months.alias("months"))


def infer_frequency(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, freq, gap_seconds, gap_months)``: the commonest gap of each series, of equally common ones the shortest.

    Gaps are counted by length, combined on the map side.  Gaps between ends of months count by months, so bars labelled with
    the ends of months have one gap, whatever the length of the month.  ``freq`` is the name of a known frequency, else
    null; a series of one row has no gap.
    """
    gaps = _gaps(df, block_rows)
    by_month = F.coalesce(F.col("months"), F.lit(0))
    gap = F.struct(F.when(by_month > 0, 0).otherwise(F.col("seconds")).alias("s"), by_month.alias("m"))
    counted = gaps.groupBy(KEY, gap.alias("gap")).agg(F.count(F.lit(1)).alias("c"), F.min("seconds").alias("shortest"))
    best = counted.groupBy(KEY).agg(F.max_by("gap", F.struct("c", -F.col("shortest"))).alias("g"))
    name = F.when(F.col("g.m") == 1, MONTH_END)
    for seconds, label in FREQ_NAMES.items():
        name = name.when((F.col("g.m") == 0) & (F.col("g.s") == seconds), label)
    found = best.select(KEY, name.alias("freq"), F.col("g.s").alias("gap_seconds"), F.col("g.m").alias("gap_months"))
    return df.select(KEY).distinct().join(found, KEY, "left")


def future_label_by_gap(ts: str | Column, steps: int) -> Column:
    """The date ``steps`` bars after ``ts`` in the gap of the row's series (columns of ``infer_frequency``); null without one."""
    c = F.col(ts) if isinstance(ts, str) else ts
    months = F.last_day(F.add_months(F.to_date(c), steps * F.col("gap_months"))).cast("timestamp_ntz")
    seconds = c + F.make_dt_interval(secs=(F.col("gap_seconds") * steps).cast("decimal(18,6)"))
    return F.date_format(F.when(F.col("gap_months") > 0, months).otherwise(seconds), "yyyy-MM-dd")
