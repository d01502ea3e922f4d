"""Unit-root test and comparison of forecast accuracy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.probability import normal_cdf, unit_root_critical, unit_root_p_value
from barloom.operators.linear import cross_products, solve, square
from barloom.operators.ordered import lagged
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, attach_series, over_blocks, renumber, series_length


TINY = 1e-14  # a residual below this share of the changes is rounding


def default_lags(n: int) -> int:
    """Longest lag tried for n observations."""
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def longest_default(rows: DataFrame) -> int:
    """The longest lag that any series of a numbered, staged table tries; reads one number."""
    return default_lags(rows.agg(F.max(POS)).first()[0] or 0)


def _adf_from_gram(gram: np.ndarray, m: int, lags: int, y: int) -> tuple[int | None, float]:
    """Pick the lag order by the information criterion on the common sample; none where no order leaves a residual.
    Columns: constant, level, lagged changes, and the change as column ``y``."""
    best, best_score = None, math.inf
    for k in range(lags + 1):
        if m <= k + 2:
            break
        _, ssr, _ = solve(gram, list(range(k + 2)), y)
        if not ssr > TINY * gram[y, y]:
            continue
        score = m * (math.log(2 * math.pi * ssr / m) + 1.0) + 2 * (k + 2)
        if score < best_score:
            best, best_score = k, score
    return best, best_score


def adf_test(df: DataFrame, column: str, max_lag: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC.

    A series tries ``default_lags`` of its own length, at most ``max_lag``; one that is too short, constant or without
    residual gets nulls.  The lag order is chosen on rows that have all
    those lags; the statistic uses every row that has the chosen lags, so each row enters
    one of ``max_lag + 1`` nested sums: rows are keyed by the number of lags they have.
    """
    rows = renumber(df.select(KEY, POS, column).where(F.col(column).isNotNull()), block_rows)

    def add(t: DataFrame) -> DataFrame:
        t = t.withColumn("_change", F.col(column) - lagged(column))
        design = [F.lit(1.0), lagged(column)] + [lagged("_change", k) for k in range(1, max_lag + 1)]
        return t.withColumn("row", F.array(*design, F.col("_change")))

    designed = over_blocks(rows, add, behind=max_lag + 1, block_rows=block_rows).where(F.col(POS) > 1)
    # Head rows miss lags; they are kept as zeros under their own key and used where they fit.
    depth = F.least(F.col(POS) - 2, F.lit(max_lag))
    keyed = designed.select(
        F.concat_ws("\x1f", F.col(KEY), depth.cast("string")).alias(KEY),
        F.transform("row", lambda v: F.coalesce(v, F.lit(0.0))).alias("row"),
    )
    parts = cross_products(keyed).select(
        F.substring_index(KEY, "\x1f", 1).alias(KEY),
        F.substring_index(KEY, "\x1f", -1).cast("int").alias("depth"),
        "gram",
        "m",
    )

    measures = ["stat", "p_value", "used_lag", "nobs", "crit_1", "crit_5", "crit_10", "aic"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = {int(d): (square(g), int(m)) for d, g, m in zip(pdf["depth"], pdf["gram"], pdf["m"])}
        unknown = pd.DataFrame([{KEY: pdf[KEY].iloc[0]} | dict.fromkeys(measures)])
        rows_in_all = sum(c for _, c in grams.values())
        most = min(max_lag, default_lags(rows_in_all + 1))
        common = [v for d, v in grams.items() if d >= most]
        if not common:
            return unknown
        lag, score = _adf_from_gram(sum(g for g, _ in common), sum(c for _, c in common), most, max_lag + 2)
        if lag is None:
            return unknown
        fits = [v for d, v in grams.items() if d >= lag]
        gram, used = sum(g for g, _ in fits), sum(c for _, c in fits)
        xs = list(range(lag + 2))
        beta, ssr, inverse = solve(gram, xs, max_lag + 2)
        variance = ssr / (used - len(xs)) * inverse[1, 1] if used > len(xs) else 0.0
        if not variance > 0:
            return unknown
        stat = beta[1] / math.sqrt(variance)
        levels = {c: unit_root_critical(c, used) for c in ("crit_1", "crit_5", "crit_10")}
        return pd.DataFrame(
            [{KEY: pdf[KEY].iloc[0], "stat": stat, "p_value": unit_root_p_value(stat), "used_lag": lag,
              "nobs": used, **levels, "aic": score}]
        )

    # max_lag + 1 rows per series reach one group.
    return parts.groupBy(KEY).applyInPandas(
        test,
        f"{KEY} string, stat double, p_value double, used_lag bigint, nobs bigint, "
        "crit_1 double, crit_5 double, crit_10 double, aic double",
    )


def model_pairs(predictions: DataFrame, models: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that all models predict, numbered, one row per unordered pair of models.
    The number of pairs depends on the models only."""
    wide = predictions.groupBy(KEY, POS, TS).agg(
        F.max("true").alias("true"),
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"_m{i}") for i, m in enumerate(models)],
    )
    common = renumber(wide.na.drop(), block_rows)
    pairs = [
        F.struct(
            F.lit(models[a]).alias("model_a"),
            F.lit(models[b]).alias("model_b"),
            (F.col("true") - F.col(f"_m{a}")).alias("error_a"),
            (F.col("true") - F.col(f"_m{b}")).alias("error_b"),
        )
        for a in range(len(models))
        for b in range(a + 1, len(models))
    ]
    return common.select(KEY, TS, POS, F.explode(F.array(*pairs)).alias("_pair")).select(KEY, TS, POS, "_pair.*")


def dm_test(predictions: DataFrame, models: list[str], norm: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Diebold-Mariano comparison of every unordered pair of models.

    Rows are folded two by two (the first is dropped if their number is odd); the statistic is the
    mean loss difference over its standard error.  ``p_a_worse`` is the one-sided p-value of "a is
    no worse than b" (small: b is better), ``p_b_worse`` the other side.
    """
    pairs = model_pairs(predictions, models, block_rows)
    sized = attach_series(pairs, series_length(pairs), block_rows=block_rows)
    odd = F.col("n") % 2
    kept = sized.where(F.col(POS) > odd)
    loss_a, loss_b = (F.pow(F.abs(e), F.lit(norm)) for e in ("error_a", "error_b"))
    folded = kept.groupBy(KEY, "model_a", "model_b", F.floor((F.col(POS) - odd - 1) / 2).alias("_fold")).agg(
        F.avg(loss_a - loss_b).alias("_d"), F.sum(loss_a).alias("_la"), F.sum(loss_b).alias("_lb")
    )
    stat = F.try_divide(F.avg("_d"), F.sqrt(F.var_pop("_d") / F.count("_d")))
    out = folded.groupBy(KEY, "model_a", "model_b").agg(
        (F.count("_d") * 2).alias("rows"),
        (F.sum("_la") / (F.count("_d") * 2)).alias("loss_a"),
        (F.sum("_lb") / (F.count("_d") * 2)).alias("loss_b"),
        stat.alias("stat"),
    )
    return out.withColumns({"p_a_worse": 1 - normal_cdf("stat"), "p_b_worse": normal_cdf("stat")})


def dm_verdict(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The significantly better model of each pair, or none."""
    better = F.when(F.col("p_a_worse") < alpha, F.col("model_b")).when(F.col("p_b_worse") < alpha, F.col("model_a"))
    return tested.withColumn("better", better)
