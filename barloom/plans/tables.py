"""The series tables that the catalog derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import month_key
from barloom.operators.bars import STEP_SECONDS, ticks_to_bars
from barloom.operators.ordered import split_by_share
from barloom.plans.blocks import number_rows, register_blocks
from barloom.plans.staging import stage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as daily bars of one series; days without orders are missing."""
    return ticks_to_bars(
        read(spark, sf_dir, "orders"),
        F.lit("orders"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "D",
    )


def event_bars(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    """Event values as bars, one series per event type."""
    return ticks_to_bars(
        read(spark, sf_dir, "events"),
        F.col("event_type"), F.col("ts"), F.col("value"), F.struct("ts", "event_id"), freq,
    )


def numbered_with_registry(bars: DataFrame, freq: str) -> tuple[DataFrame, DataFrame]:
    """Bars staged and numbered, and the registry of their blocks: the raw scan happens once, and the bars are read once for
    the registry and once by whatever uses them."""
    staged = stage(bars, f"bars-{freq}")
    registry = register_blocks(staged, STEP_SECONDS[freq])
    return number_rows(staged, STEP_SECONDS[freq], registry=registry), registry


def numbered(bars: DataFrame, freq: str) -> DataFrame:
    return number_rows(stage(bars, f"bars-{freq}"), STEP_SECONDS[freq])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(daily_bars(spark, sf_dir), "D")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(event_bars(spark, sf_dir, "h"), "h")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(event_bars(spark, sf_dir, "min"), "min")


def daily_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with their split, staged: models and stacks read them several times."""
    rows, registry = numbered_with_registry(daily_bars(spark, sf_dir), "D")
    return stage(split_by_share(rows, registry=registry), "daily-split")


def monthly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(month_key("l_shipdate").alias("month")).agg((F.avg("l_discount") * 100).alias("fed_rate"))


def monthly_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(month_key("l_shipdate").alias("month")).agg(F.sum("l_extendedprice").alias("m2_supply"))
