"""Ordered-window features on numbered tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEY,
    POS,
    TS,
    attach_series,
    ordered,
    over_blocks,
    registered_blocks,
    running_total,
    series_length,
    trailing,
    with_block,
)

DAYS_PER_YEAR = 365


# Column builders: use them inside ``over_blocks``.


def lagged(c: str | Column, h: int = 1) -> Column:
    return F.lag(c, h).over(ordered())


def difference(c: str, h: int = 1) -> Column:
    return F.col(c) - lagged(c, h)


def log_return(c: str) -> Column:
    return F.log(c) - lagged(F.log(c))


def _full(c: str, n: int, value: Column) -> Column:
    """Null until the frame holds n values."""
    return F.when(F.count(c).over(trailing(n)) == n, value)


def rolling_mean_of(c: str, n: int) -> Column:
    return _full(c, n, F.avg(c).over(trailing(n)))


def rolling_std_of(c: str, n: int) -> Column:
    return _full(c, n, F.stddev_samp(c).over(trailing(n)))


def true_range() -> Column:
    previous = lagged("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(previous - F.col("low"))
    )


def signed_volume() -> Column:
    """Volume with the sign of the price move; null where the price did not move."""
    previous = lagged("close")
    return F.when(F.col("close") > previous, F.col("volume")).when(F.col("close") < previous, -F.col("volume"))


# Table operators.


def log_returns(df: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``log_c`` and ``log_returns_c`` for each column."""

    def add(t: DataFrame) -> DataFrame:
        return t.withColumns(
            {f"log_{c}": F.log(c) for c in columns} | {f"log_returns_{c}": log_return(c) for c in columns}
        )

    return over_blocks(df, add, behind=1, block_rows=block_rows)


def lag_and_diff(df: DataFrame, column: str, h: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Series, value h rows back, change over h rows."""

    def add(t: DataFrame) -> DataFrame:
        return t.withColumns({f"lag_{h}": lagged(column, h), f"diff_{h}": difference(column, h)})

    return over_blocks(df.select(KEY, TS, POS, column), add, behind=h, block_rows=block_rows)


def rolling_mean(df: DataFrame, outputs: dict[str, tuple[str, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Simple moving averages: ``{new column: (column, rows)}``."""
    reach = max(n for _, n in outputs.values()) - 1
    return over_blocks(
        df,
        lambda t: t.withColumns({o: rolling_mean_of(c, n) for o, (c, n) in outputs.items()}),
        behind=reach,
        block_rows=block_rows,
    )


def rolling_std(df: DataFrame, outputs: dict[str, tuple[str, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sample standard deviations: ``{new column: (column, rows)}``."""
    reach = max(n for _, n in outputs.values()) - 1
    return over_blocks(
        df,
        lambda t: t.withColumns({o: rolling_std_of(c, n) for o, (c, n) in outputs.items()}),
        behind=reach,
        block_rows=block_rows,
    )


def annualized_volatility(df: DataFrame, rows: int = 30, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling deviation of the close's log return, scaled to a year."""

    def add(t: DataFrame) -> DataFrame:
        return t.withColumn("log_return", log_return("close")).withColumn(
            "rolling_volatility", rolling_std_of("log_return", rows) * math.sqrt(DAYS_PER_YEAR)
        )

    return over_blocks(df, add, behind=rows, block_rows=block_rows)


def average_true_range(df: DataFrame, rows: int = 14, block_rows: int = BLOCK_ROWS) -> DataFrame:
    def add(t: DataFrame) -> DataFrame:
        return (
            t.withColumn("true_range", true_range())
            .withColumn(f"atr_{rows}", rolling_mean_of("true_range", rows))
            .drop("true_range")
        )

    return over_blocks(df, add, behind=rows, block_rows=block_rows)


def on_balance_volume(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative signed volume; null on rows where the price did not move."""
    moved = over_blocks(df, lambda t: t.withColumn("_move", signed_volume()), behind=1, block_rows=block_rows)
    return (
        running_total(moved, {"_obv": "_move"}, block_rows)
        .withColumn("obv", F.when(F.col("_move").isNotNull(), F.col("_obv")))
        .drop("_move", "_obv")
    )


def gap_aware_change(
    df: DataFrame, column: str = "close", step_seconds: int = 60, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Relative change to the previous row (nulls padded first); null right after a time gap.

    The padded value and the time before a block come from the ends of blocks, so rows are shuffled once."""
    tagged = with_block(df, block_rows)
    ends = tagged.groupBy(KEY, BLOCK).agg(F.expr(f"max_by(`{column}`, {POS}) FILTER (WHERE `{column}` IS NOT NULL)").alias("_pad"), F.max(TS).alias("_at"))
    blocks_before = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(KEY, BLOCK, *[F.last(c, True).over(blocks_before).alias(c) for c in ("_pad", "_at")])
    rows_before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    previous = F.coalesce(F.last(column, True).over(rows_before), F.col("_pad"))
    rows = tagged.join(carry, [KEY, BLOCK]).withColumns({"_previous": previous, "_since": F.coalesce(lagged(TS), F.col("_at"))})
    close_by = F.col(TS) - F.col("_since") <= F.make_dt_interval(secs=F.lit(step_seconds))
    change = F.when(close_by, F.try_divide(F.coalesce(column, "_previous"), "_previous") - 1)
    return rows.withColumn("pct_change", change).drop(BLOCK, "_pad", "_at", "_previous", "_since")


def lagged_month_change(df: DataFrame, column: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Change on the previous row in percent, one row late so it was known at that time."""

    def add(t: DataFrame) -> DataFrame:
        change = (F.try_divide(lagged(column, 1), lagged(column, 2)) - 1) * 100
        return t.withColumn(out, change)

    return over_blocks(df, add, behind=2, block_rows=block_rows)


def top_rows(df: DataFrame, column: str = "volume", k: int = 10) -> DataFrame:
    """The k largest rows of the whole table; ties by series and time."""
    return df.orderBy(F.col(column).desc(), KEY, TS).limit(k)


def last_rows(df: DataFrame, k: int) -> DataFrame:
    """The last k rows of each series.

    They have k different remainders of the position modulo k, so the last row of each remainder is one of them: a combined
    aggregate, and only k rows per series and task are shuffled.
    """
    if k < 1:
        return df.limit(0)
    row = F.max_by(F.struct(*df.columns), POS).alias("_row")
    return df.groupBy(KEY, F.pmod(POS, F.lit(k)).alias("_turn")).agg(row).select("_row.*")


def from_split(df: DataFrame, split: str, behind: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows from ``behind`` rows before a split's first row: all that frames of the split can see."""
    first = F.min(F.when(F.col("split") == split, F.col(POS))).alias("_first")
    near = attach_series(df, series_length(df, first), block_rows=block_rows)
    return near.where(F.col(POS) >= F.col("_first") - behind).drop("n", "_first")


def last_two(df: DataFrame, column: str = "close") -> DataFrame:
    """Last and second-last value with the last time, one row per series.

    One of the two has an even position, the other an odd one, so two combined aggregates find both without a sort.
    """
    found = {}
    for turn in (0, 1):
        at = F.when(F.col(POS) % 2 == turn, F.col(POS))
        found |= {f"_at_{turn}": F.max(at), f"_value_{turn}": F.max_by(column, at)}
    ends = df.groupBy(KEY).agg(F.max(TS).alias("last_ts"), *[c.alias(name) for name, c in found.items()])
    even_last = F.coalesce(F.col("_at_0"), F.lit(0)) > F.coalesce(F.col("_at_1"), F.lit(0))
    return ends.select(
        KEY, "last_ts",
        F.when(even_last, F.col("_value_0")).otherwise(F.col("_value_1")).alias("last_value"),
        F.when(even_last, F.col("_value_1")).otherwise(F.col("_value_0")).alias("prev_value"),
    )


def split_by_share(
    df: DataFrame, train: float = 0.8, valid: float = 0.1, block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None
) -> DataFrame:
    """Add ``split``: the first share of positions is train, the next valid, the rest test.
    With a ``registry`` of the numbering the rows are read once, else once more for their lengths."""
    n = F.col("n").cast("double")
    first = F.floor(n * train)
    second = first + F.floor(n * valid)
    if registry is None:
        sized = attach_series(df, series_length(df), block_rows=block_rows)
    else:
        sized = with_block(df, block_rows).join(registered_blocks(registry, block_rows), [KEY, BLOCK]).drop(BLOCK)
    return (
        sized.withColumn("split", F.when(F.col(POS) <= first, "train").when(F.col(POS) <= second, "valid").otherwise("test"))
        .drop("n")
    )


def split_bounds(df: DataFrame) -> DataFrame:
    """Last time of train and of valid per series, for a later split of a derived table."""
    ends = {s: F.max(F.when(F.col("split") == s, F.col(TS))).alias(f"{s}_end") for s in ("train", "valid")}
    return series_length(df, *ends.values())


def split_at_bounds(df: DataFrame, bounds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """train <= a < valid <= b < test at the saved boundary times."""
    return (
        attach_series(df, bounds, block_rows=block_rows)
        .withColumn(
            "split",
            F.when(F.col(TS) <= F.col("train_end"), "train")
            .when(F.col(TS) <= F.col("valid_end"), "valid")
            .otherwise("test"),
        )
        .drop("n", "train_end", "valid_end")
    )


def stationarity_table(df: DataFrame, column: str = "close", rows: int = 30) -> DataFrame:
    """Series with its rolling mean and deviation."""

    def add(t: DataFrame) -> DataFrame:
        return t.withColumns(
            {"rolling_mean": rolling_mean_of(column, rows), "rolling_std": rolling_std_of(column, rows)}
        )

    return over_blocks(df.select(KEY, TS, POS, column), add, behind=rows - 1)


def trend_table(df: DataFrame) -> DataFrame:
    """Close and volume with their 50- and 200-row means, volume also with its 30-row mean."""
    return rolling_mean(
        df.select(KEY, TS, POS, "close", "volume"),
        {
            "close_ma_50": ("close", 50),
            "close_ma_200": ("close", 200),
            "volume_ma_30": ("volume", 30),
            "volume_ma_50": ("volume", 50),
            "volume_ma_200": ("volume", 200),
        },
    )
