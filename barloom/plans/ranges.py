"""Running counts over sorted values of any number: a sample sort instead of one sorted task a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.staging import stage

RANGE_ROWS = 1 << 20
_PART = "_range_no"


def running_counts(df: DataFrame, keys: list[str], order: list[str], count: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_from`` and ``_to``: the sum of ``count`` in a row's group before it and up to it, in ``order``.

    ``df`` is a staged table whose rows differ in ``keys`` and ``order``.  Rows are dealt out by ranges of (keys, order), as many as
    the table's size asks for; ranges that come out too large are cut again.  One total for each range and group is summed
    up, then each range counts by itself.
    """
    rows = df.count()
    if rows <= range_rows:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return _with_start(df.withColumn("_to", F.sum(count).over(upto)), count)
    parts = -(-rows // range_rows)
    while True:
        dealt = stage(df.repartitionByRange(parts, *keys, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
        sizes = dealt.groupBy(_PART).agg(F.count("*").alias("rows"))
        largest = sizes.agg(F.max("rows")).first()[0]  # one number
        if largest <= 2 * range_rows or parts >= rows:
            break
        parts = min(rows, 2 * parts)
    totals = dealt.groupBy(*keys, _PART).agg(F.sum(count).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _PART, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(offsets, [*keys, _PART]).withColumn("_to", F.col("_offset") + F.sum(count).over(inside))
    return _with_start(placed.drop("_offset", _PART), count)


def _with_start(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn("_from", F.col("_to") - F.col(count))
