"""Outlier thresholds, classes and repair for fine bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import BAR_COLUMNS
from barloom.operators.quantiles import exact_quantiles
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, attach_series, fill_forward, ordered, over_blocks, series_length
from barloom.plans.staging import stage

# Quantile levels, share of a spike that must revert, class labels.
EXTREME_LEVEL = 0.9999
LOW_VOLUME_LEVEL = 0.05
REVERSION_SHARE = 0.75
HIGH_CONFIDENCE = "High Confidence Error"
LIKELY = "Likely Error"
SUSPICIOUS = "Suspicious"
REAL_EVENT = "Possible Real Market Event"


def integrity_report(df: DataFrame) -> DataFrame:
    """Counts of impossible or empty bars, per series; nothing is filtered."""
    negative = sum(
        (F.count_if(F.col(c) < 0) for c in ("open", "high", "low", "close")[1:]), F.count_if(F.col("open") < 0)
    )
    return df.groupBy(KEY).agg(
        negative.alias("negative_prices"),
        F.count_if(F.col("high") < F.col("low")).alias("high_less_than_low"),
        F.count_if(F.col("volume") == 0).alias("zero_trading_volume"),
    )


def threshold_quantiles(df: DataFrame, block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None) -> DataFrame:
    """Per series: extreme move, extreme spread, low volume."""
    sized = df.select(
        KEY,
        POS,
        F.abs("pct_change").alias("_move"),
        F.abs("intra_minute_spread").alias("_spread"),
        F.when(F.col("volume") > 0, F.col("volume")).alias("_volume"),
    )
    return exact_quantiles(
        sized,
        [KEY],
        {
            "pct_change_threshold": ("_move", EXTREME_LEVEL),
            "spread_threshold": ("_spread", EXTREME_LEVEL),
            "volume_threshold": ("_volume", LOW_VOLUME_LEVEL),
        },
        block_rows=block_rows,
        registry=registry,
    )


def outlier_thresholds(df: DataFrame, block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None) -> DataFrame:
    """The thresholds with the length of each series.  ``df`` carries ``pct_change`` and ``intra_minute_spread``."""
    return series_length(df).join(threshold_quantiles(df, block_rows, registry), KEY, "left")


def is_candidate() -> Column:
    """Beyond the move or the spread threshold."""
    move = F.abs("pct_change") > F.col("pct_change_threshold")
    spread = F.abs("intra_minute_spread") > F.col("spread_threshold")
    return F.coalesce(move, F.lit(False)) | F.coalesce(spread, F.lit(False))


def outlier_candidates(df: DataFrame, thresholds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows beyond the move or the spread threshold."""
    return attach_series(df, thresholds, block_rows=block_rows).where(is_candidate())


def outlier_class() -> Column:
    """Class of a candidate from its close, those before and after it, and its volume; null for the first and last row of a
    series, which have only one neighbour."""
    spike = F.abs(F.col("close") - F.col("_before"))
    back = F.abs(F.col("close") - F.col("_after"))
    reverted = F.coalesce((spike > 0) & (back / spike > REVERSION_SHARE), F.lit(False))
    low = F.coalesce((F.col("volume") == 0) | (F.col("volume") < F.col("volume_threshold")), F.lit(False))
    label = F.when(reverted & low, HIGH_CONFIDENCE).when(reverted, LIKELY).when(low, SUSPICIOUS).otherwise(REAL_EVENT)
    return F.when((F.col(POS) > 1) & (F.col(POS) < F.col("n")), label)


def is_wrong() -> Column:
    return outlier_class().isin(HIGH_CONFIDENCE, LIKELY)


def classify_outliers(df: DataFrame, thresholds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Candidates with their class.  Neighbours are read before rows are filtered."""

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        return t.withColumns({"_before": F.lag("close").over(o), "_after": F.lead("close").over(o)})

    with_neighbours = over_blocks(df, add, behind=1, ahead=1, block_rows=block_rows)
    rows = outlier_candidates(with_neighbours, thresholds, block_rows).withColumn("classification", outlier_class())
    return rows.where(F.col("classification").isNotNull()).drop("_before", "_after", "n")


def impute_outliers(df: DataFrame, classified: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blank the bars of both error classes and carry the last bar forward.

    The few wrong rows are staged: both passes of the fill read them.
    """
    wrong = classified.where(F.col("classification").isin(HIGH_CONFIDENCE, LIKELY)).select(
        KEY, POS, F.lit(True).alias("_wrong")
    )
    wrong = stage(wrong, "wrong-bars")
    blanked = df.join(wrong, [KEY, POS], "left")
    blanked = blanked.withColumns({c: F.when(F.col("_wrong").isNull(), F.col(c)) for c in BAR_COLUMNS})
    return fill_forward(blanked.drop("_wrong"), BAR_COLUMNS, block_rows)
