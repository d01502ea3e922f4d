"""Least squares from sufficient statistics.

Tasks turn Arrow batches of design rows into partial cross-product matrices; the
partial matrices (k*k numbers each) are summed by Spark, and one small solve per
series follows.  Rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import KEY

_PARTIAL = f"{KEY} string, i int, v double"


def cross_products(df: DataFrame, row: str = "row") -> DataFrame:
    """Per series the flattened matrix sum(row' row) of an array column, and the row count ``m``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(KEY, sort=False):
                x = np.vstack(part[row].to_numpy())
                flat = np.append((x.T @ x).ravel(), float(len(x)))
                yield pd.DataFrame({KEY: key, "i": np.arange(len(flat), dtype="int32"), "v": flat})

    parts = df.select(KEY, row).mapInPandas(partial, _PARTIAL).groupBy(KEY, "i").agg(F.sum("v").alias("v"))
    # k*k + 1 numbers per series, in order.
    flat = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    packed = parts.groupBy(KEY).agg(flat.alias("_flat"))
    size = F.size("_flat")
    return packed.select(
        KEY,
        F.slice("_flat", F.lit(1), size - 1).alias("gram"),
        F.element_at("_flat", -1).cast("bigint").alias("m"),
    )


def square(flat) -> np.ndarray:
    """The matrix of a flattened ``gram`` value."""
    a = np.asarray(flat, dtype="float64")
    k = int(round(np.sqrt(a.size)))
    return a.reshape(k, k)


def solve(gram: np.ndarray, xs: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients of columns ``xs`` for column ``y``, residual sum of squares, inverse of X'X.

    Columns are scaled to unit length before inversion, which keeps mixed magnitudes stable.
    """
    scale = np.sqrt(np.diag(gram)[xs])
    scale[scale == 0] = 1.0
    xx = gram[np.ix_(xs, xs)] / np.outer(scale, scale)
    xy = gram[xs, y] / scale
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    beta = inverse @ xy
    beta = beta + inverse @ (xy - xx @ beta)
    ssr = max(float(gram[y, y] - 2 * beta @ xy + beta @ xx @ beta), 0.0)
    return beta / scale, ssr, inverse / np.outer(scale, scale)


def least_squares(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """One row per series: ``coefficients`` (intercept first, if any), ``m`` rows, ``ssr``.
    Rows with a null in any column are left out."""
    lead = [F.lit(1.0)] if intercept else []
    rows = df.na.drop(subset=[y, *xs]).select(
        KEY, F.array(*lead, *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")).alias("row")
    )
    k = len(xs) + len(lead)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, flat, m in zip(pdf[KEY], pdf["gram"], pdf["m"]):
            beta, ssr, _ = solve(square(flat), list(range(k)), k)
            out.append((key, beta.tolist(), int(m), ssr))
        return pd.DataFrame(out, columns=[KEY, "coefficients", "m", "ssr"])

    return cross_products(rows).mapInPandas(
        lambda batches: map(fit, batches), f"{KEY} string, coefficients array<double>, m bigint, ssr double"
    )
