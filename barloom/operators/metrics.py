"""Scores of prediction tables ``(series_id, model, ts, pos, true, pred, base)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.joins import attach_baseline
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, ordered, over_blocks, renumber

EPSILON = 2.220446049250313e-16  # smallest relative step of a double


def mape_of(true: str = "true", pred: str = "pred") -> Column:
    t, p = F.col(true), F.col(pred)
    return F.avg(F.abs(t - p) / F.greatest(F.abs(t), F.lit(EPSILON))) * 100


def _share(hit: Column, empty: float) -> Column:
    return F.coalesce(F.avg(hit.cast("double")) * 100, F.lit(empty))


def mape(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(KEY, "model").agg(mape_of().alias("mape"))


def da_by_change(predictions: DataFrame, h: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Direction of change over h rows of truth against that of the prediction; 50 if empty.
    Each model of a series is numbered by itself; its positions have no holes."""
    own = predictions.withColumn("_series", F.col(KEY)).withColumn(KEY, F.concat_ws("\x1f", KEY, "model"))

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        return t.withColumns(
            {"_dt": F.col("true") - F.lag("true", h).over(o), "_dp": F.col("pred") - F.lag("pred", h).over(o)}
        )

    moved = over_blocks(renumber(own, block_rows), add, behind=h, block_rows=block_rows)
    hit = F.when(F.col("_dt").isNotNull() & F.col("_dp").isNotNull(), F.signum("_dt") == F.signum("_dp"))
    return moved.groupBy(F.col("_series").alias(KEY), "model").agg(_share(hit, 50.0).alias("da"))


def direction_hit(true: str = "true", pred: str = "pred", base: str = "base") -> Column:
    return F.signum(F.col(true) - F.col(base)) == F.signum(F.col(pred) - F.col(base))


def da_by_baseline(predictions: DataFrame, history: DataFrame, h: int) -> DataFrame:
    """Direction from the value h rows back; 0 if no row has one."""
    with_base = attach_baseline(predictions.drop("base"), history, h).withColumnRenamed("baseline", "base")
    scored = with_base.groupBy(KEY, "model").agg(_share(direction_hit(), 0.0).alias("da"))
    models = predictions.groupBy(KEY, "model").agg(F.count(F.lit(1)).alias("rows"))
    return models.join(scored, [KEY, "model"], "left").select(KEY, "model", F.coalesce("da", F.lit(0.0)).alias("da"))


def da_by_return_sign(predictions: DataFrame) -> DataFrame:
    """Sign of the predicted return against that of the true one-row return.
    Needs ``true_return`` and ``pred_return``."""
    hit = F.signum("pred_return") == F.signum("true_return")
    return predictions.groupBy(KEY, "model").agg(_share(hit, 50.0).alias("da"))


def score(predictions: DataFrame) -> DataFrame:
    """MAPE and direction from ``base``, one row per series and model."""
    return predictions.groupBy(KEY, "model").agg(
        mape_of().alias("mape"), _share(direction_hit(), 0.0).alias("da"), F.count(F.lit(1)).alias("rows")
    )


def residuals(predictions: DataFrame) -> DataFrame:
    return predictions.select(KEY, "model", TS, POS, (F.col("true") - F.col("pred")).alias("residual"))


def beating(metrics: DataFrame, baseline: str) -> DataFrame:
    """Models with a lower MAPE and a higher DA than the baseline model of their series."""
    floor = metrics.where(F.col("model") == baseline).select(
        KEY, F.col("mape").alias("_mape"), F.col("da").alias("_da")
    )
    return (
        metrics.where(F.col("model") != baseline)
        .join(floor, KEY)
        .where((F.col("mape") < F.col("_mape")) & (F.col("da") > F.col("_da")))
        .drop("_mape", "_da")
    )


def select_best(metrics: DataFrame, baseline: str) -> DataFrame:
    """Best model per series among those that beat the baseline: highest DA, then lowest MAPE.
    No row for a series means that none beats it."""
    rank = F.struct(F.col("da"), -F.col("mape"), F.col("model"))
    chosen = beating(metrics, baseline).groupBy(KEY).agg(F.max_by(F.struct("model", "mape", "da"), rank).alias("_b"))
    return chosen.select(KEY, "_b.*")


def leaderboard(metrics: DataFrame, sort_by: str = "da") -> DataFrame:
    if sort_by == "da":
        return metrics.orderBy(F.col("da").desc(), "mape", "model")
    if sort_by == "mape":
        return metrics.orderBy(F.col("mape").asc(), F.col("da").desc(), "model")
    raise ValueError("sort_by must be 'mape' or 'da'")
