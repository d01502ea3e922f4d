"""Cleaning of fine bars in one pass over the rows.

Grid, removal of a day, change, spread and the neighbours that outlier classes need all follow from a raw row, the rows next to
it and what earlier and later blocks end with.  So one window over the raw rows gives them, and the grid unfolds with
everything in place: one staged table, which thresholds and repair read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import range_pct, zero_flag
from barloom.operators.bars import BAR_COLUMNS, standardize_bars
from barloom.operators.grid import on_grid
from barloom.operators.outliers import integrity_report, is_candidate, is_wrong, threshold_quantiles
from barloom.plans.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEY,
    POS,
    TIME_BLOCK,
    TS,
    by_block,
    epoch_seconds,
    from_epoch,
    ordered,
    with_block,
)
from barloom.plans.staging import stage

DAY_SECONDS = 86400


def _block_ends(rows: DataFrame, live: Column) -> DataFrame:
    """Per time block: bounds of the series, the next block's start, and the nearest live rows outside the block."""
    point, at = F.struct("_s", "close"), F.when(live, F.col("_s"))
    known = F.when(live & F.col("close").isNotNull(), F.col("_s"))
    ends = rows.groupBy(KEY, TIME_BLOCK).agg(
        F.min("_s").alias("_first"), F.max("_s").alias("_last"),
        F.min_by(point, at).alias("_head"), F.max_by(point, at).alias("_tail"), F.max_by("close", known).alias("_known"),
    )
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(TIME_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.desc(TIME_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        KEY, TIME_BLOCK, F.min("_first").over(whole).alias("_start"), F.max("_last").over(whole).alias("_end"),
        F.lead("_first").over(whole.orderBy(TIME_BLOCK)).alias("_onward"), F.last("_tail", True).over(before).alias("_tail"),
        F.last("_head", True).over(after).alias("_head"), F.last("_known", True).over(before).alias("_known"),
    )


def fused_bars(
    df: DataFrame, step_seconds: int = 60, day: str | None = None, block_rows: int = BLOCK_ROWS, aligned: bool = False
) -> DataFrame:
    """The complete grid without ``day``, numbered, with ``is_zero_volume``, ``intra_minute_spread``, ``pct_change``, the closes
    next to each row ``_before`` and ``_after``, and the length ``n`` of the series."""
    values = [c for c in df.columns if c not in (KEY, TS, POS)]
    source = df if aligned else on_grid(df, step_seconds, block_rows)
    block = F.floor(F.col("_s") / F.lit(step_seconds * block_rows))
    rows = source.select(KEY, epoch_seconds(TS).alias("_s"), *values).withColumn(TIME_BLOCK, block)
    out = epoch_seconds(F.lit(f"{day} 00:00:00").cast("timestamp_ntz")) if day else F.lit(None).cast("bigint")
    live = F.coalesce((F.col("_s") < out) | (F.col("_s") >= out + DAY_SECONDS), F.lit(True))

    inside = Window.partitionBy(KEY, TIME_BLOCK).orderBy("_s")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_point", F.when(live, F.struct("_s", "close"))).withColumn("_close", F.when(live, F.col("close")))
    rows = rows.join(_block_ends(rows, live), [KEY, TIME_BLOCK]).withColumns(
        {
            "_next": F.coalesce(F.lead("_s").over(inside), "_onward", F.col("_s") + step_seconds),
            "_prev": F.coalesce(F.last("_point", True).over(earlier), "_tail"),
            "_foll": F.coalesce(F.expr(f"lead(_point, 1) IGNORE NULLS OVER (PARTITION BY {KEY}, {TIME_BLOCK} ORDER BY _s)"), "_head"),
            "_pad0": F.coalesce(F.last("_close", True).over(earlier), "_known"),
        }
    )

    def place(seconds: Column) -> Column:
        return F.floor((seconds - F.col("_start")) / step_seconds).cast("bigint") + 1

    def rows_before(seconds: Column) -> Column:
        return F.greatest(F.ceil((seconds - F.col("_start")) / step_seconds), F.lit(0)).cast("bigint")

    def shifted(p: Column) -> Column:
        """Position once the day's rows ``(_a, _b]`` are gone."""
        return F.when(p > F.col("_b"), p - (F.col("_b") - F.col("_a"))).otherwise(F.least(p, F.col("_a"))) if day else p

    if day:
        rows = rows.withColumns({"_a": rows_before(out), "_b": rows_before(out + DAY_SECONDS)})
    gaps = rows.select(
        KEY, "_start", *(["_a", "_b"] if day else []), place(F.col("_s")).alias("_own"), place(F.col("_next")).alias("_until"),
        shifted(place(F.col("_end"))).alias("n"), "_pad0", F.coalesce("_close", "_pad0").alias("_pad1"),
        F.when(shifted(place(F.col("_prev._s"))) == shifted(place(F.col("_s"))) - 1, F.col("_prev.close")).alias("_before"),
        F.when(shifted(place(F.col("_foll._s"))) == shifted(place(F.col("_s"))) + 1, F.col("_foll.close")).alias("_after"),
        *values,
    )
    # Long gaps unfold in two steps, so no array exceeds block_rows entries.
    chunks = gaps.withColumn("_from", F.explode(F.sequence("_own", F.col("_until") - 1, F.lit(block_rows).cast("bigint"))))
    grid = chunks.withColumn("_p", F.explode(F.sequence("_from", F.least(F.col("_from") + block_rows, F.col("_until")) - 1)))
    own, p = F.col("_p") == F.col("_own"), F.col("_p")
    change = F.try_divide("_pad1", F.when(own, F.col("_pad0")).otherwise(F.col("_pad1"))) - 1
    if day:
        grid = grid.where((p <= F.col("_a")) | (p > F.col("_b")))
        change = F.when((p != F.col("_b") + 1) | (F.col("_a") == F.col("_b")), change)  # no change across the removed day
    bars = grid.select(
        KEY,
        from_epoch(F.col("_start") + (p - 1) * step_seconds).alias(TS),
        *[F.when(own, F.col(c)).alias(c) for c in values],
        shifted(p).alias(POS),
        change.alias("pct_change"),
        *[F.when(own, F.col(c)).alias(c) for c in ("_before", "_after")],
        "n",
    )
    return bars.withColumns({"is_zero_volume": zero_flag("volume"), "intra_minute_spread": range_pct()})


def clean_bars(
    df: DataFrame, step_seconds: int = 60, day: str | None = None, block_rows: int = BLOCK_ROWS, aligned: bool = False
) -> DataFrame:
    """Full cleaning: grid, removal of a day, change and spread, repair of outliers of both error classes by the last bar."""
    kept = [c for c in df.columns if c not in (KEY, TS, POS)]
    fused = stage(fused_bars(df, step_seconds, day, block_rows, aligned), "fused-bars")
    limits = fused.groupBy(KEY).agg(F.max("n").alias("n")).join(threshold_quantiles(fused, block_rows), KEY, "left")
    rows = with_block(fused.drop("n"), block_rows).join(by_block(limits, "n", block_rows), [KEY, BLOCK])
    wrong = F.coalesce(is_candidate() & is_wrong(), F.lit(False))
    rows = rows.withColumns({c: F.when(~wrong, F.col(c)) for c in BAR_COLUMNS})
    ends = rows.groupBy(KEY, BLOCK).agg(*[F.expr(f"max_by(`{c}`, {POS}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_p_{c}") for c in BAR_COLUMNS])
    earlier = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(KEY, BLOCK, *[F.last(f"_p_{c}", True).over(earlier).alias(f"_p_{c}") for c in BAR_COLUMNS])
    here = ordered().rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(here), F.col(f"_p_{c}")) for c in BAR_COLUMNS}
    names = [KEY, TS, *kept, POS, "is_zero_volume", "intra_minute_spread", "pct_change"]
    return rows.join(carry, [KEY, BLOCK]).withColumns(filled).select(*names)


def clean_raw_bars(
    raw: DataFrame, series: str, step_seconds: int = 60, day: str | None = None, block_rows: int = BLOCK_ROWS, aligned: bool = False
) -> tuple[DataFrame, DataFrame]:
    """From a raw six-column table: the cleaned bars, and the counts of impossible or empty bars before the repair."""
    bars = stage(standardize_bars(raw, series), "standard-bars")
    return clean_bars(bars, step_seconds, day, block_rows, aligned), integrity_report(bars)
