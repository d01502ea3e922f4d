"""Multi-step pipelines: derived bars, evaluate all models, residual tables.  Cleaning as a whole: ``plans.cleaning``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import range_pct, zero_flag
from barloom.operators import autoregression, datasets, forecasters, joins, metrics, stats
from barloom.operators.grid import exclude_grid_day, fill_grid
from barloom.operators.ordered import gap_aware_change
from barloom.operators.tests_of_series import dm_test
from barloom.plans.blocks import BLOCK_ROWS, KEY
from barloom.plans.staging import stage


def derived_bars(
    df: DataFrame, step_seconds: int, day: str | None, block_rows: int = BLOCK_ROWS, aligned: bool = False
) -> DataFrame:
    """Grid, removal of a day, zero-volume flag, change and spread."""
    grid = fill_grid(df, step_seconds, block_rows, aligned)
    if day:
        grid = exclude_grid_day(grid, day, step_seconds)
    flagged = stage(grid, "grid").withColumns({"is_zero_volume": zero_flag("volume"), "intra_minute_spread": range_pct()})
    return gap_aware_change(flagged, "close", step_seconds, block_rows)


def residual_panel(predictions: DataFrame, lags: int, block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """Tables behind a residual plot of one model: series, histogram, density, correlations, quantiles."""
    series = metrics.residuals(predictions)
    return {
        "series": series,
        "histogram": stats.histogram(series, "residual", 30, block_rows),
        "density": stats.kernel_density(series, "residual", 1000, 0.5, block_rows),
        "acf": stats.autocorrelation(series, "residual", lags, block_rows),
        "pacf": stats.partial_autocorrelation(series, "residual", lags, block_rows),
        "quantiles": stats.normal_quantile_points(series, "residual", block_rows),
    }


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame  # on the test rows, all models
    forecasts: DataFrame  # (series_id, model, ts_future, pred, sig): past the end of each series


def evaluate_models(
    bars: DataFrame, features: DataFrame, numeric: list[str], h: int, window: int, order=(5, 1, 3),
    learners: dict[str, object] | None = None, align: str = "strict", block_rows: int = BLOCK_ROWS, ar_window: int = 60,
    freq: str = "D",
) -> Evaluation:
    """Predictions on the test rows and final forecasts of all models: persistence, autoregression, direct learners and
    a stack of persistence with each learner.

    Models that are tested are fitted on train and valid together, scaler and labels included, with as many trees as the
    first fit chose on valid; the stack is fitted on what first fits (train only) predict for valid.  Forecasts come from
    the same fits and the last window, that of the autoregression from a fit on all rows.  The autoregression is applied to
    windows of ``ar_window`` rows.

    ``bars`` and ``features`` carry ``split`` and share positions.  Both should be staged tables:
    each model reads them.
    """
    learners = learners or {"linear": forecasters.linear_learner()}
    tables, frames, matrices = {}, {}, {}
    for fit_splits, split in ((datasets.FIRST_FIT, "valid"), (datasets.REFIT, "test")):
        matrix = stage(datasets.model_matrix(features, numeric, "log_returns_close", block_rows, fit_splits), "matrix")
        lagged = datasets.lag_feature_table(matrix, window, [h], block_rows, fit_splits)
        tables[split], matrices[split] = stage(lagged, "lag-table"), matrix
        frames[split] = datasets.walk_forward_frames(matrix, window, h, split, align, block_rows)
    order_name = f"ar({','.join(map(str, order))})"
    parts = [
        forecasters.persistence(bars, h, "test", block_rows),
        autoregression.ar_backtest(bars, order, ar_window, h, "test", datasets.REFIT, block_rows=block_rows),
    ]
    naive = forecasters.naive_forecast(bars, h, freq)
    ends = {"persistence": naive, order_name: autoregression.ar_forecast(bars, order, h, freq, block_rows=block_rows)}
    first = forecasters.concurrently({n: lambda l=l: forecasters.fit_validated(tables["valid"], l, h, datasets.FIRST_FIT) for n, l in learners.items()})
    again = forecasters.concurrently({n: lambda n=n, l=l: forecasters.refit(first[n], tables["test"], l, h, datasets.REFIT) for n, l in learners.items()})
    for name in learners:
        valid = forecasters.apply_direct(first[name], frames["valid"], name)
        test = forecasters.apply_direct(again[name], frames["test"], name).select(*forecasters.PREDICTION_COLUMNS)
        bases = ["persistence", name]
        meta = forecasters.stack_fit(
            joins.union_splits(
                forecasters.persistence(features, h, "valid", block_rows),
                valid.select(*forecasters.PREDICTION_COLUMNS),
            ),
            bases,
        )
        both = joins.union_splits(forecasters.persistence(features, h, "test", block_rows), test)
        parts += [test, forecasters.stack_predictions(both, meta, bases, f"stack_{name}", block_rows)]
        ends[name] = forecasters.direct_forecast(again[name], tables["test"], matrices["test"], h, freq)
        wide = naive.select(KEY, F.col("pred").alias("persistence")).join(ends[name].select(KEY, F.col("pred").alias(name)), KEY)
        ends[f"stack_{name}"] = forecasters.stack_forecast(wide, meta, bases, bars, h, freq)
    predictions = stage(joins.union_splits(*[p.select(*forecasters.PREDICTION_COLUMNS) for p in parts]), "predictions")
    named = [f.select(KEY, F.lit(name).alias("model"), "ts_future", "pred", "sig") for name, f in ends.items()]
    return Evaluation(predictions, joins.union_splits(*named))


def evaluate_all(*args, **kwargs) -> DataFrame:
    """The predictions of ``evaluate_models``."""
    return evaluate_models(*args, **kwargs).predictions


def compare_models(predictions: DataFrame, models: list[str], sort_by: str = "da") -> tuple[DataFrame, DataFrame]:
    """Leaderboard and pairwise accuracy tests (absolute loss) of one prediction table."""
    return metrics.leaderboard(metrics.score(predictions), sort_by), dm_test(predictions, models, norm=1)
