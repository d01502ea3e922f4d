"""Complete time grids, gap interpolation, removal of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEY,
    POS,
    TS,
    epoch_seconds,
    fill_forward,
    from_epoch,
    neighbours,
)


def on_grid(df: DataFrame, step_seconds: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose distance from the start of their series is a whole number of steps; grids begin at whole seconds."""
    df = df.where(F.expr(f"extract(SECOND FROM {TS}) % 1 = 0"))
    seconds = epoch_seconds(TS)
    # The start joins on (series, time block), so a hot series is not one join key.
    tagged = df.withColumn("_tb", F.floor(seconds / F.lit(step_seconds * block_rows)))
    blocks = tagged.groupBy(KEY, "_tb").agg(F.min(seconds).alias("_first"))
    starts = blocks.select(KEY, "_tb", F.min("_first").over(Window.partitionBy(KEY)).alias("_start"))
    joined = tagged.join(starts, [KEY, "_tb"])
    return joined.where((seconds - F.col("_start")) % step_seconds == 0).select(*df.columns)


def fill_grid(
    df: DataFrame, step_seconds: int, block_rows: int = BLOCK_ROWS, aligned: bool = False
) -> DataFrame:
    """Put each series on min..max of its time at a fixed step; missing rows are null.

    On a grid the position follows from the time, so nothing has to be ranked.  Each
    row emits itself and the missing rows up to its successor, so the grid is neither
    generated apart nor shuffled.  Rows off the grid are dropped, as a reindex does;
    ``aligned`` says there are none (bars of a fixed frequency) and saves that check.
    """
    values = [c for c in df.columns if c not in (KEY, TS, POS)]
    source = df if aligned else on_grid(df, step_seconds, block_rows)
    rows = source.select(KEY, epoch_seconds(TS).alias("_s"), *values).withColumn(
        BLOCK, F.floor(F.col("_s") / F.lit(step_seconds * block_rows))
    )
    # Per time block: the start of the series and the first row of the next block.
    whole = Window.partitionBy(KEY)
    blocks = (
        rows.groupBy(KEY, BLOCK)
        .agg(F.min("_s").alias("_first"))
        .select(
            KEY,
            BLOCK,
            F.min("_first").over(whole).alias("_start"),
            F.lead("_first").over(whole.orderBy(BLOCK)).alias("_onward"),
        )
    )
    inside = Window.partitionBy(KEY, BLOCK).orderBy("_s")
    following = F.coalesce(F.lead("_s").over(inside), F.col("_onward"), F.col("_s") + step_seconds)

    def place(seconds):
        return F.floor((seconds - F.col("_start")) / step_seconds).cast("bigint") + 1

    gaps = rows.join(blocks, [KEY, BLOCK]).withColumn("_next", following).select(
        KEY, "_start", place(F.col("_s")).alias(POS), place(F.col("_next")).alias("_until"), *values
    )
    # Long gaps unfold in two steps, so no array exceeds block_rows entries.
    chunks = gaps.withColumn(
        "_from", F.explode(F.sequence(F.col(POS), F.col("_until") - 1, F.lit(block_rows).cast("bigint")))
    )
    grid = chunks.withColumn(
        "_p", F.explode(F.sequence("_from", F.least(F.col("_from") + block_rows, F.col("_until")) - 1))
    )
    return grid.select(
        KEY,
        from_epoch(F.col("_start") + (F.col("_p") - 1) * step_seconds).alias(TS),
        *[F.when(F.col("_p") == F.col(POS), F.col(c)).alias(c) for c in values],
        F.col("_p").alias(POS),
    )


def missing_share(grid: DataFrame, column: str = "close") -> DataFrame:
    """Rows and percentage of rows without a value, per series."""
    gone = F.count_if(F.col(column).isNull())
    return grid.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        gone.alias("missing"),
        (gone / F.count(F.lit(1)) * 100).alias("missing_pct"),
    )


def exclude_day(df: DataFrame, day: str) -> DataFrame:
    """Drop all rows of one calendar day, as a range on ``ts`` so files can be skipped."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return df.where((F.col(TS) < start) | (F.col(TS) >= start + F.expr("INTERVAL '1' DAY")))


def exclude_grid_day(grid: DataFrame, day: str, step_seconds: int) -> DataFrame:
    """``exclude_day`` on a complete grid, closing the hole in ``pos``: how many grid rows the
    day held follows from the start of the series, so no row has to be counted."""
    start = epoch_seconds(TS) - (F.col(POS) - 1) * step_seconds
    first = epoch_seconds(F.lit(f"{day} 00:00:00").cast("timestamp_ntz"))

    def rows_before(t):
        return F.greatest(F.ceil((t - start) / step_seconds), F.lit(0)).cast("bigint")

    removed = F.when(epoch_seconds(TS) >= first + 86400, rows_before(first + 86400) - rows_before(first)).otherwise(0)
    return exclude_day(grid.withColumn(POS, F.col(POS) - removed), day)


def interpolate_grid(grid: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation by position.  Leading nulls stay; trailing nulls take the last value."""
    out = neighbours(grid, columns, block_rows)

    def blend(c: str):
        before, after = F.col(f"_pv_{c}"), F.col(f"_nv_{c}")
        share = (F.col(POS) - F.col(f"_pp_{c}")) / (F.col(f"_np_{c}") - F.col(f"_pp_{c}"))
        return F.when(F.col(c).isNotNull() | after.isNull(), before).otherwise(before + (after - before) * share)

    return out.withColumns({c: blend(c) for c in columns}).select(*grid.columns)


def fill_gaps(
    df: DataFrame, step_seconds: int, columns: list[str], method: str = "linear", block_rows: int = BLOCK_ROWS,
    aligned: bool = False,
) -> DataFrame:
    """Complete grid, then interpolation (``linear``) or last value (``ffill``)."""
    grid = fill_grid(df, step_seconds, block_rows, aligned)
    if method == "linear":
        return interpolate_grid(grid, columns, block_rows)
    if method == "ffill":
        return fill_forward(grid, columns, block_rows)
    raise ValueError("method must be 'linear' or 'ffill'")
