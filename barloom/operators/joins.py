"""Macro series at a lower frequency, unions, alignment of predictions, order grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import month_key
from barloom.operators.ordered import lagged, lagged_month_change
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, fill_forward, over_blocks, renumber

MACRO_COLUMNS = ["fed_rate", "m2_supply_mom_pct"]


def join_months(rate: DataFrame, supply: DataFrame) -> DataFrame:
    """Inner join of two monthly tables ``(month, value)``."""
    return rate.join(supply, "month")


def macro_table(rate: DataFrame, supply: DataFrame, rate_lag_months: int = 0) -> DataFrame:
    """Monthly rate and lagged change of supply; ``rate_lag_months`` delays the rate as well,
    for uses where a month's rate is not known during that month."""
    months = join_months(rate, supply)
    keyed = months.withColumns(
        {
            KEY: F.lit("macro"),
            TS: F.col("month").cast("timestamp_ntz"),
            POS: (F.year("month") * 12 + F.month("month")).cast("bigint"),
        }
    )
    changed = lagged_month_change(renumber(keyed), "m2_supply", "m2_supply_mom_pct")
    if rate_lag_months:
        changed = over_blocks(
            changed, lambda t: t.withColumn("fed_rate", lagged("fed_rate", rate_lag_months)), behind=rate_lag_months
        )
    return changed.select("month", "fed_rate", "m2_supply_mom_pct")


def join_macro(df: DataFrame, macro: DataFrame) -> DataFrame:
    """Left join on the calendar month.  The macro side has 12 rows a year."""
    return df.withColumn("month", month_key(TS)).join(macro, "month", "left").drop("month")


def add_macro(df: DataFrame, macro: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Month values, then the last value forward, then 0 before the first."""
    return fill_forward(join_macro(df, macro), MACRO_COLUMNS, block_rows).na.fill(0.0, subset=MACRO_COLUMNS)


def union_splits(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; a column missing in one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def align_predictions(predictions: DataFrame, models: list[str]) -> DataFrame:
    """One row per target row that all models predict, one column per model."""
    wide = predictions.groupBy(KEY, POS, TS).agg(
        F.max("true").alias("true"),
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models],
    )
    return wide.na.drop(subset=models)


def attach_baseline(predictions: DataFrame, history: DataFrame, h: int, column: str = "close") -> DataFrame:
    """Attach the history value h rows before each target row; rows without one are dropped."""
    base = history.select(KEY, (F.col(POS) + h).alias(POS), F.col(column).alias("baseline"))
    return predictions.join(base, [KEY, POS]).na.drop(subset=["baseline"])


def order_grid(spark: SparkSession, p: list[int], d: list[int], q: list[int]) -> DataFrame:
    """All (p, d, q) combinations."""
    axes = F.array(*[F.lit(v) for v in p]), F.array(*[F.lit(v) for v in d]), F.array(*[F.lit(v) for v in q])
    return (
        spark.range(1)
        .select(F.explode(axes[0]).alias("p"))
        .select("p", F.explode(axes[1]).alias("d"))
        .select("p", "d", F.explode(axes[2]).alias("q"))
    )


def orders_of(series: DataFrame, p: list[int], d: list[int], q: list[int]) -> DataFrame:
    """All (p, d, q) combinations for each row of ``series``: lists of parameters unfold, nothing is joined or collected."""
    out, rest = series, [c for c in series.columns if c != KEY]
    for name, values in (("p", p), ("d", d), ("q", q)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.select(KEY, "p", "d", "q", *rest)
