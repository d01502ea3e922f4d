"""Forecasters and their walk-forward tests.

A forecaster is a function from a table to ``(series_id, model, ts, pos, true, pred, base)``;
everything downstream (scores, stacks, tests) reads only that.
"""

from __future__ import annotations

import math
import random
import statistics
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import HOLD_THRESHOLD, direction_signal, future_label, price_from_log_return
from barloom.operators.frequency import future_label_by_gap, infer_frequency
from barloom.operators.joins import align_predictions
from barloom.operators.linear import least_squares
from barloom.operators.ordered import last_two
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, attach_series, ordered, over_blocks, series_length, trailing

AT_ONCE = 4  # fits that run at the same time
_HELD_OUT = "held_out"
PREDICTION_COLUMNS = [KEY, "model", TS, POS, "true", "pred", "base"]


def _in_split(split: str | None, h: int):
    if split is None:
        return F.lit(True)
    return (F.col("split") == split) & (F.lag("split", h).over(ordered()) == split)


def _simple(df: DataFrame, h: int, split: str | None, name: str, forecast, behind: int, block_rows: int) -> DataFrame:
    """Predictions whose value is a frame expression h rows before the target."""

    def add(t: DataFrame) -> DataFrame:
        t = t.withColumn("_forecast", forecast())
        o = ordered()
        return t.withColumns(
            {
                "pred": F.lag("_forecast", h).over(o),
                "base": F.lag("close", h).over(o),
                "_kept": _in_split(split, h),
            }
        )

    rows = over_blocks(df, add, behind=behind + h, block_rows=block_rows)
    return rows.where(F.col("_kept") & F.col("pred").isNotNull() & F.col("close").isNotNull()).select(
        KEY, F.lit(name).alias("model"), TS, POS, F.col("close").alias("true"), "pred", "base"
    )


def persistence(df: DataFrame, h: int, split: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The value h rows ago."""
    return _simple(df, h, split, "persistence", lambda: F.col("close"), 0, block_rows)


def trailing_mean(
    df: DataFrame, h: int, rows: int, split: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The mean of the last ``rows`` values known h rows ago."""
    return _simple(
        df, h, split, f"mean_{rows}",
        lambda: F.when(F.count("close").over(trailing(rows)) == rows, F.avg("close").over(trailing(rows))),
        rows - 1, block_rows,
    )


def _dated(ends: DataFrame, history: DataFrame, h: int, freq: str | None) -> DataFrame:
    """``ends`` with ``ts_future``, h bars on in the given frequency, or in that of each series."""
    if freq:
        return ends.withColumn("ts_future", future_label("last_ts", h, freq))
    gaps = infer_frequency(history).select(KEY, "gap_seconds", "gap_months")
    return ends.join(gaps, KEY).withColumn("ts_future", future_label_by_gap("last_ts", h))


def naive_forecast(df: DataFrame, h: int, freq: str | None = None, hold: float = HOLD_THRESHOLD) -> DataFrame:
    """Last value as forecast; the signal compares the last two values.  Without ``freq`` it is inferred for each series."""
    return _dated(last_two(df), df, h, freq).select(
        KEY,
        "ts_future",
        F.col("last_value").alias("pred"),
        direction_signal("last_value", "prev_value", hold).alias("sig"),
    )


def final_forecast(
    preds: DataFrame, history: DataFrame, h: int, freq: str | None = None, hold: float = HOLD_THRESHOLD
) -> DataFrame:
    """``(series_id, pred)`` to the forecast record: date, value, signal against the last value."""
    return preds.join(_dated(last_two(history), history, h, freq), KEY).select(
        KEY,
        "ts_future",
        "pred",
        direction_signal("pred", "last_value", hold).alias("sig"),
    )


# ------------------------------------------------------------ direct learners


def boosted_trees(**params) -> GBTRegressor:
    """Boosted trees with a fixed seed; pass Spark parameter names."""
    defaults = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
    return GBTRegressor(featuresCol="vector", labelCol="label", predictionCol="scaled", **(defaults | params))


def linear_learner(**params) -> LinearRegression:
    """Least squares in closed form; a little ridge keeps one-hot columns solvable."""
    defaults = {"solver": "normal", "regParam": 1e-6, "elasticNetParam": 0.0}
    return LinearRegression(featuresCol="vector", labelCol="label", predictionCol="scaled", **(defaults | params))


def fit_direct(lag_table: DataFrame, learner, h: int, splits: tuple[str, ...] = ("train",)):
    """Fit one learner for one horizon on the complete rows of the given splits, all series pooled."""
    check_horizon(h, lag_table)
    rows = lag_table.where(F.col("split").isin(*splits) & F.col(f"label_{h}").isNotNull())
    return learner.fit(rows.select(array_to_vector("features").alias("vector"), F.col(f"label_{h}").alias("label")))


def validated_trees(**params) -> GBTRegressor:
    """Boosted trees that stop where another tree no longer lowers the error of the validation rows."""
    return boosted_trees(**({"maxIter": 200, "validationTol": 1e-4} | params)).setValidationIndicatorCol(_HELD_OUT)


def is_validated(learner) -> bool:
    return isinstance(learner, GBTRegressor) and learner.isSet("validationIndicatorCol")


def fit_validated(lag_table: DataFrame, learner, h: int, splits: tuple[str, ...] = ("train",), valid: str = "valid"):
    """Fit one horizon; a learner of ``validated_trees`` chooses its number of trees on the rows of ``valid``."""
    if not is_validated(learner):
        return fit_direct(lag_table, learner, h, splits)
    check_horizon(h, lag_table)
    rows = lag_table.where(F.col("split").isin(*splits, valid) & F.col(f"label_{h}").isNotNull())
    held_out = F.col("split") == valid
    if rows.where(held_out).isEmpty():
        raise ValueError(f"no rows of split {valid} to choose the number of trees on")
    return learner.fit(rows.select(array_to_vector("features").alias("vector"), F.col(f"label_{h}").alias("label"), held_out.alias(_HELD_OUT)))


def fit_horizons(
    lag_table: DataFrame, learner, horizons: list[int], splits: tuple[str, ...] = ("train",), valid: str = "valid",
    at_once: int = AT_ONCE,
) -> dict[int, object]:
    """One fitted learner for each horizon.  The fits read one staged table and run ``at_once`` at a time, as Spark jobs
    of their own."""
    return concurrently({h: lambda h=h: fit_validated(lag_table, learner, h, splits, valid) for h in horizons}, at_once)


def concurrently(work: dict, at_once: int = AT_ONCE) -> dict:
    """Results of functions that submit Spark jobs, by key."""
    own_thread = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(at_once, len(work)))) as pool:
        return dict(zip(work, pool.map(lambda f: own_thread(f)(), work.values()), strict=True))


def with_rounds_of(learner, fitted):
    """The learner for a refit on joined splits: as many trees as were chosen, and no validation any more."""
    if not is_validated(learner):
        return learner
    again = learner.copy({learner.maxIter: max(1, fitted.getNumTrees)})
    again.clear(again.validationIndicatorCol)
    return again


def refit(first, lag_table: DataFrame, learner, h: int, splits: tuple[str, ...] = ("train", "valid")):
    """Fit again on ``splits`` with what the fit ``first`` has chosen."""
    return fit_direct(lag_table, with_rounds_of(learner, first), h, splits)


def apply_direct(fitted, frames: DataFrame, name: str, rows_ahead: int = 1) -> DataFrame:
    """Score walk-forward frames: a projection, no loop.  The learned value is a scaled log return, of one row, or with
    cumulative labels of ``rows_ahead`` rows; the price is the base times its exponential."""
    scored = fitted.transform(frames.withColumn("vector", array_to_vector("features")))
    mean = F.col("mean") * rows_ahead
    truth = F.col("true_return") if rows_ahead == 1 else F.log(F.col("true") / F.col("base"))
    return scored.select(
        KEY, F.lit(name).alias("model"), TS, POS, "true",
        price_from_log_return("base", "scaled", mean, "std").alias("pred"), "base", truth.alias("true_return"),
        (F.col("scaled") * F.col("std") + mean).alias("pred_return"),
    )


def check_horizon(h: int, lag_table: DataFrame) -> None:
    """A learner can be fitted for the horizons that the table has labels for."""
    known = sorted(int(c.removeprefix("label_")) for c in lag_table.columns if c.startswith("label_"))
    if h not in known:
        raise ValueError(f"no labels for horizon {h}; the table has {known}")


def direct_forecast(
    fitted, lag_table: DataFrame, matrix: DataFrame, h: int, freq: str, hold: float = HOLD_THRESHOLD, rows_ahead: int = 1
) -> DataFrame:
    """Forecast from the last window of each series; ``rows_ahead`` as in ``apply_direct``."""
    last = lag_table.groupBy(KEY).agg(F.max_by("features", POS).alias("features"))
    scale = matrix.groupBy(KEY).agg(
        F.max_by("mean", POS).alias("mean"), F.max_by("std", POS).alias("std"), F.max_by("close", POS).alias("base")
    )
    frames = last.join(scale, KEY).withColumn("vector", array_to_vector("features"))
    price = price_from_log_return("base", "scaled", F.col("mean") * rows_ahead, "std")
    preds = fitted.transform(frames).select(KEY, price.alias("pred"))
    return final_forecast(preds, matrix, h, freq, hold)


def score_external(scaled: DataFrame, frames: DataFrame, name: str) -> DataFrame:
    """Scaled predictions made elsewhere ``(series_id, pos, scaled)`` to the prediction table."""
    return frames.join(scaled, [KEY, POS]).select(
        KEY, F.lit(name).alias("model"), TS, POS, "true",
        price_from_log_return("base", "scaled", "mean", "std").alias("pred"), "base", "true_return",
        (F.col("scaled") * F.col("std") + F.col("mean")).alias("pred_return"),
    )


def _validation_error(lag_table: DataFrame, learner, h: int, valid: str) -> tuple[float, int]:
    """Mean absolute error on the validation rows, and their number."""
    rows = lag_table.where((F.col("split") == valid) & F.col(f"label_{h}").isNotNull())
    scored = fit_direct(lag_table, learner, h).transform(rows.withColumn("vector", array_to_vector("features")))
    got = scored.agg(F.avg(F.abs(F.col("scaled") - F.col(f"label_{h}"))), F.count(F.lit(1))).first()
    return (float("nan") if got[0] is None else float(got[0])), int(got[1])


def _search_table(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "trial string, rounds int, mae double, rows bigint, pruned boolean").orderBy("pruned", F.desc("rounds"), "mae", "trial")


def grid_search(lag_table: DataFrame, learners: dict[str, object], h: int, valid: str = "valid", at_once: int = AT_ONCE) -> DataFrame:
    """Mean absolute error of each learner on the validation rows of one horizon, best first."""
    if not learners:
        raise ValueError("at least one learner is needed")
    check_horizon(h, lag_table)
    errors = concurrently({name: lambda l=l: _validation_error(lag_table, l, h, valid) for name, l in learners.items()}, at_once)
    table = lag_table.sparkSession.createDataFrame([(name, *e) for name, e in errors.items()], "trial string, mae double, rows bigint")
    return table.orderBy("mae", "trial")


def random_trees(trials: int = 15, seed: int = 42) -> dict[str, GBTRegressor]:
    """Boosted trees with parameters drawn from fixed ranges (depth, step, rows and features of a tree, rows of a leaf)."""
    # The ranges of the search.
    depth, step, share, leaf = (3, 10), (0.005, 0.1), (0.7, 1.0), (1, 10)
    draw, found = random.Random(seed), {}
    for i in range(trials):
        params = {
            "maxDepth": draw.randint(*depth),
            "stepSize": math.exp(draw.uniform(math.log(step[0]), math.log(step[1]))),
            "subsamplingRate": draw.uniform(*share),
            "featureSubsetStrategy": f"{draw.uniform(*share):.3f}",
            "minInstancesPerNode": draw.randint(*leaf),
        }
        found[f"trial_{i:02d}"] = boosted_trees(**params)
    return found


def pruned_search(
    lag_table: DataFrame, learners: dict[str, GBTRegressor], h: int, rungs: tuple[int, ...] = (2, 6, 18), valid: str = "valid",
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Errors of boosted trees on the validation rows, best first, with trials given up early.

    All trials grow the trees of the first rung; those above the median error are pruned, the others grow on to the next, so a
    rung costs half as many trials as the one before.  One row a trial, with the rounds it reached; those of the last rung
    come first.
    """
    if not learners or list(rungs) != sorted(set(rungs)):
        raise ValueError("a search needs learners and rising rungs")
    check_horizon(h, lag_table)
    alive, rows = dict(learners), []
    for rounds in rungs:
        grown = {name: l.copy({l.maxIter: rounds}) for name, l in alive.items()}
        errors = concurrently({name: lambda l=l: _validation_error(lag_table, l, h, valid) for name, l in grown.items()}, at_once)
        limit = statistics.median(e for e, _ in errors.values()) if rounds != rungs[-1] else math.inf
        rows += [(name, rounds, *e, True) for name, e in errors.items() if e[0] > limit]
        alive = {name: l for name, l in alive.items() if not errors[name][0] > limit}
    return _search_table(lag_table.sparkSession, rows + [(name, rungs[-1], *errors[name], False) for name in alive])


# --------------------------------------------------------------------- stacks


def stack_fit(valid_predictions: DataFrame, bases: list[str]) -> DataFrame:
    """Least squares of the truth on the predictions of the base models, per series."""
    return least_squares(align_predictions(valid_predictions, bases), "true", bases)


def _combined(bases: list[str]):
    return sum(
        (F.col("coefficients")[i + 1] * F.col(b) for i, b in enumerate(bases)), F.col("coefficients")[0]
    )


def stack_predictions(
    test_predictions: DataFrame, coefficients: DataFrame, bases: list[str], name: str = "stack",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply the fitted combination to the test predictions of the base models."""
    wide = align_predictions(test_predictions, bases)
    base = test_predictions.where(F.col("model") == bases[0]).select(KEY, POS, "base")
    sized = series_length(wide).join(coefficients.select(KEY, "coefficients"), KEY)
    return attach_series(wide, sized, block_rows=block_rows).join(base, [KEY, POS]).select(
        KEY, F.lit(name).alias("model"), TS, POS, "true", _combined(bases).alias("pred"), "base"
    )


def stack_forecast(
    base_forecasts: DataFrame, coefficients: DataFrame, bases: list[str], history: DataFrame, h: int, freq: str,
    hold: float = HOLD_THRESHOLD,
) -> DataFrame:
    """``base_forecasts`` has one column per base model and one row per series."""
    preds = base_forecasts.join(coefficients, KEY).select(KEY, _combined(bases).alias("pred"))
    return final_forecast(preds, history, h, freq, hold)
