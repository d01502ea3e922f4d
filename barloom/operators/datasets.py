"""Learning data from feature tables: scaling, one-hot, lag tables, sequences, walk-forward frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import RSI_LABELS
from barloom.operators.ordered import from_split
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, attach_series, ordered, over_blocks, series_length, trailing


FIRST_FIT = ("train",)
REFIT = ("train", "valid")  # the joined history that a model is fitted on again before the test


def _fitted_on(c: str, fit_splits: tuple[str, ...]):
    return F.when(F.col("split").isin(*fit_splits), F.col(c))


def scaler_table(df: DataFrame, numeric: list[str], fit_splits: tuple[str, ...] = FIRST_FIT) -> DataFrame:
    """Per series: mean and population deviation of the rows of ``fit_splits``; deviation 0 becomes 1."""
    stats = []
    for c in numeric:
        deviation = F.stddev_pop(_fitted_on(c, fit_splits))
        stats += [F.avg(_fitted_on(c, fit_splits)).alias(f"_mean_{c}"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"_std_{c}")]
    return series_length(df, *stats)


def standard_scale(
    df: DataFrame, numeric: list[str], block_rows: int = BLOCK_ROWS, fit_splits: tuple[str, ...] = FIRST_FIT,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Add ``z_c`` for each numeric column, fitted on the rows of ``fit_splits`` only."""
    scaled = attach_series(df, scaler_table(df, numeric, fit_splits), block_rows=block_rows, registry=registry)
    return scaled.withColumns(
        {f"z_{c}": (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in numeric}
    ).drop("n", *[f"_{s}_{c}" for c in numeric for s in ("mean", "std")])


def state_columns() -> list[str]:
    return [f"state_{label}" for label in sorted(RSI_LABELS)]


def one_hot_state(
    df: DataFrame, column: str = "rsi_state", block_rows: int = BLOCK_ROWS, fit_splits: tuple[str, ...] = FIRST_FIT
) -> DataFrame:
    """0/1 column per label in alphabetical order; a label unseen in ``fit_splits`` gives all zeros."""
    seen = {
        label: F.coalesce(F.max(F.col("split").isin(*fit_splits) & (F.col(column) == label)), F.lit(False)).alias(f"_seen_{label}")
        for label in sorted(RSI_LABELS)
    }
    flagged = attach_series(df, series_length(df, *seen.values()), block_rows=block_rows)
    hot = {
        f"state_{label}": F.coalesce((F.col(column) == label) & F.col(f"_seen_{label}"), F.lit(False)).cast("double")
        for label in seen
    }
    return flagged.withColumns(hot).drop("n", *[f"_seen_{label}" for label in seen])


def model_matrix(
    df: DataFrame, numeric: list[str], target: str, block_rows: int = BLOCK_ROWS, fit_splits: tuple[str, ...] = FIRST_FIT,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Scaled numeric and one-hot columns as one array ``x``, with the scale of the target.

    Both are fitted on the rows of ``fit_splits`` and share one pass and one join.
    """
    labels = sorted(RSI_LABELS)
    seen = [
        F.coalesce(F.max(F.col("split").isin(*fit_splits) & (F.col("rsi_state") == l)), F.lit(False)).alias(f"_seen_{l}")
        for l in labels
    ]
    stats = [F.avg(_fitted_on(c, fit_splits)).alias(f"_mean_{c}") for c in numeric] + [
        F.stddev_pop(_fitted_on(c, fit_splits)).alias(f"_std_{c}") for c in numeric
    ]
    fitted = series_length(df, *stats, *seen)

    def std(c: str):
        return F.when(F.col(f"_std_{c}") == 0, 1.0).otherwise(F.col(f"_std_{c}"))

    scaled = [(F.col(c) - F.col(f"_mean_{c}")) / std(c) for c in numeric]
    hot = [F.coalesce((F.col("rsi_state") == l) & F.col(f"_seen_{l}"), F.lit(False)).cast("double") for l in labels]
    return attach_series(df, fitted, block_rows=block_rows, registry=registry).select(
        KEY, TS, POS, "split", "close",
        F.col(target).alias("target"),
        F.array(*scaled, *hot).alias("x"),
        scaled[numeric.index(target)].alias("z"),
        F.col(f"_mean_{target}").alias("mean"),
        std(target).alias("std"),
    )


def _window(rows: int, column: str = "x"):
    """The last ``rows`` arrays, oldest first, as one flat array; null until complete."""
    frame = F.collect_list(column).over(trailing(rows))
    return F.when(F.size(frame) == rows, F.flatten(frame))


def lag_feature_table(
    matrix: DataFrame, window: int, horizons: list[int], block_rows: int = BLOCK_ROWS, fit_splits: tuple[str, ...] = FIRST_FIT,
    label: str = "step",
) -> DataFrame:
    """``features`` = the ``window`` rows ending here, ``label_h`` = scaled return of the row h rows on (``step``), or the sum
    of the scaled returns of the next h rows (``cumulative``: times ``std`` plus h times ``mean`` it is the whole return).
    A label is null unless the whole window and the label lie in the same split; the ``fit_splits`` count as one."""
    if label not in ("step", "cumulative"):
        raise ValueError("label must be 'step' or 'cumulative'")
    side = F.when(F.col("split").isin(*fit_splits), F.lit(fit_splits[0])).otherwise(F.col("split"))

    def _ahead(h: int):
        next_rows = ordered().rowsBetween(1, h)
        if label == "step":
            return F.lead("z", h).over(ordered())
        return F.when(F.count("z").over(next_rows) == h, F.sum("z").over(next_rows))

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        first = F.lag(side, window - 1).over(o)
        labels = {f"label_{h}": F.when(F.lead(side, h).over(o) == first, _ahead(h)) for h in horizons}
        return t.withColumns({"features": _window(window), **labels})

    table = over_blocks(matrix, add, behind=window - 1, ahead=max(horizons), block_rows=block_rows)
    return table.where(F.col("features").isNotNull()).select(
        KEY, TS, POS, "split", "features", *[f"label_{h}" for h in horizons]
    )


def seq2seq_windows(
    matrix: DataFrame, input_rows: int, target_rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``inputs`` (input_rows arrays) and ``targets``: for each input row the next ``target_rows``
    returns.  Only windows that are complete inside one split: N - input - target + 1 of them."""

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        around = o.rowsBetween(-(input_rows - 1), target_rows)
        returns = F.collect_list("z").over(around)
        targets = F.transform(
            F.sequence(F.lit(2), F.lit(input_rows + 1)), lambda i: F.slice(F.col("_r"), i, F.lit(target_rows))
        )
        same = F.lag("split", input_rows - 1).over(o) == F.lead("split", target_rows).over(o)
        return t.withColumns({"inputs": F.collect_list("x").over(trailing(input_rows)), "_r": returns, "_same": same}).withColumn(
            "targets", targets
        )

    rows = over_blocks(matrix, add, behind=input_rows - 1, ahead=target_rows, block_rows=block_rows)
    return rows.where(F.col("_same") & (F.size("_r") == input_rows + target_rows)).select(
        KEY, TS, POS, "split", "inputs", "targets"
    )


def walk_forward_frames(
    matrix: DataFrame, window: int, h: int, split: str, align: str = "strict", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per step of a walk-forward test: history, base price, truth h rows on.

    ``strict``: the history ends at the base row.  ``reference``: it ends one row earlier.
    Steps do not depend on each other, so they are plain rows.
    """
    if align not in ("strict", "reference"):
        raise ValueError("align must be 'strict' or 'reference'")
    late = 1 if align == "reference" else 0

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        ahead = {c: F.lead(c, h).over(o) for c in (TS, POS, "close", "target", "split")}
        history = F.collect_list("x").over(o.rowsBetween(-(window - 1 + late), -late))
        return t.withColumns(
            {
                "features": F.when(F.size(history) == window, F.flatten(history)),
                "_ts": ahead[TS],
                "_pos": ahead[POS],
                "true": ahead["close"],
                "true_return": ahead["target"],
                "_split": ahead["split"],
            }
        )

    near = from_split(matrix, split, window - 1 + late, block_rows)  # histories are built for this split alone
    steps = over_blocks(near, add, behind=window - 1 + late, ahead=h, block_rows=block_rows)
    return steps.where(
        (F.col("split") == split) & (F.col("_split") == split) & F.col("features").isNotNull()
    ).select(
        KEY, F.col("_ts").alias(TS), F.col("_pos").alias(POS), "features", "true", F.col("close").alias("base"),
        "true_return", "mean", "std",
    )
