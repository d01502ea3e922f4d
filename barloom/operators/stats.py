"""Descriptions, distributions, correlation over time, decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import month_key
from barloom.functions.probability import chi2_tail, normal_quantile
from barloom.operators.ordered import lagged
from barloom.operators.quantiles import exact_quantiles
from barloom.plans.blocks import (
    BLOCK_ROWS,
    KEY,
    POS,
    TS,
    attach_series,
    ordered,
    over_blocks,
    renumber,
    renumber_sized,
    series_length,
)
from barloom.plans.ranges import RANGE_ROWS, running_counts
from barloom.plans.staging import stage

# Confidence multiplier of the 95 % band, whisker length in quartile ranges.
BAND_95 = 1.959963984540054
WHISKER = 1.5
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_exact(
    df: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None
) -> DataFrame:
    """Per series and column: count, mean, deviation, extremes and exact quartiles."""
    types = dict(df.dtypes)
    moments, quartiles = [], {}
    for c in columns:
        x = F.col(c).cast("double")
        named = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        moments += [value.alias(f"{c}.{name}") for name, value in named.items()]
        quartiles |= {f"{c}.{name}": (c, p) for name, p in QUARTILES.items()}
    wide = df.groupBy(KEY).agg(*moments).join(
        exact_quantiles(df, [KEY], quartiles, block_rows=block_rows, registry=registry), KEY, "left"
    )
    measures = ["count", "mean", "std", "min", *QUARTILES, "max"]
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), *[F.col(f"`{c}.{m}`").alias(m) for m in measures])
        for c in columns
    ]
    return wide.select(KEY, F.explode(F.array(*rows)).alias("_r")).select(KEY, "_r.*")


def _spans(df: DataFrame, column: str, bins: int) -> DataFrame:
    spans = series_length(df, F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    return spans.withColumn("_width", (F.col("_mx") - F.col("_mn")) / bins)


def _binned(df: DataFrame, column: str, bins: int, block_rows: int) -> DataFrame:
    spans = _spans(df, column, bins)
    place = F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("_mn"), F.col("_width"))), F.lit(0))
    return (
        attach_series(df.select(KEY, POS, column).where(F.col(column).isNotNull()), spans, block_rows=block_rows)
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("bigint"))
    )


def histogram(df: DataFrame, column: str, bins: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Equal-width bins per series (the last is closed), empty ones included: edges, count and density."""
    filled = _binned(df, column, bins, block_rows).groupBy(KEY, "bin").agg(F.count(F.lit(1)).alias("count"))
    edges = _spans(df, column, bins).where(F.col("_mn").isNotNull())
    edges = edges.select(KEY, "_mn", "_width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    counts = edges.join(filled, [KEY, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(KEY))  # at most ``bins`` rows per series
    left = F.col("_mn") + F.col("bin") * F.col("_width")
    return counts.select(
        KEY,
        "bin",
        left.alias("left"),
        (left + F.col("_width")).alias("right"),
        "count",
        F.try_divide(F.col("count"), total * F.col("_width")).alias("density"),
    )


def kernel_density(
    df: DataFrame, column: str, points: int = 200, margin: float = 0.0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Gaussian density at ``points`` places over the range of the values, widened on both sides
    by the share ``margin`` of it; bandwidth by Scott's rule.

    Each task keeps one vector of ``points`` sums per series, so its shuffle holds ``points`` rows per series and task
    whatever the number of values.
    """
    x = F.col(column)
    spans = series_length(
        df,
        F.min(x).alias("_mn"),
        F.max(x).alias("_mx"),
        F.stddev_samp(x).alias("_sd"),
        F.count(x).cast("double").alias("_m"),
    )
    extent = F.col("_mx") - F.col("_mn")
    spans = spans.select(
        KEY, "n", "_m", (F.col("_sd") * F.pow("_m", F.lit(-0.2))).alias("_h"),
        (F.col("_mn") - extent * margin).alias("_low"), (extent * (1 + 2 * margin) / (points - 1)).alias("_step"),
    )
    values = df.where(x.isNotNull()).select(KEY, POS, x.cast("double").alias("_x"))
    placed = attach_series(values, spans, block_rows=block_rows)
    sums = placed.select(KEY, "_x", "_h", "_low", "_step").mapInArrow(lambda b: _density_sums(b, points), f"{KEY} string, point int, _s double")
    place = F.col("_low") + F.col("point") * F.col("_step")
    scale = F.col("_m") * F.col("_h") * float(np.sqrt(2 * np.pi))
    totals = sums.groupBy(KEY, "point").agg(F.sum("_s").alias("_s"))
    return totals.join(spans, KEY).select(KEY, "point", place.alias("x"), F.try_divide(F.col("_s"), scale).alias("density"))


def _density_sums(batches, points: int, held: int = 1024, rows: int = 256):
    """Unscaled sums of the kernel at each point per series, given out when ``held`` series are open and at the end."""
    sums: dict[str, np.ndarray] = {}

    def given():
        keys = list(sums)
        out = {KEY: np.repeat(np.array(keys, dtype=object), points), "point": np.tile(np.arange(points, dtype=np.int32), len(keys))}
        return pa.RecordBatch.from_pydict(out | {"_s": np.concatenate([sums[k] for k in keys])})

    for batch in batches:
        pdf = batch.to_pandas()
        for key, part in pdf.groupby(KEY, sort=False):
            h, low, step = (part[c].iloc[0] for c in ("_h", "_low", "_step"))
            at, total = low + np.arange(points) * step, sums.setdefault(key, np.zeros(points))
            value, count = np.unique(part["_x"].to_numpy(), return_counts=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                for i in range(0, len(value), rows):
                    z = (at[None, :] - value[i : i + rows, None]) / h
                    total += count[i : i + rows] @ np.exp(-z * z / 2)
        if len(sums) > held:
            yield given()
            sums.clear()
    if sums:
        yield given()


def monthly_box_stats(df: DataFrame, column: str) -> DataFrame:
    """Per month: quartiles, whisker ends inside 1.5 quartile ranges, number of outliers."""
    keyed = df.select(KEY, POS, month_key(TS).alias("month"), column)
    boxes = exact_quantiles(
        keyed, [KEY, "month"], {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)}
    )
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    x = F.col(column)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        keyed.where(x.isNotNull())
        .join(boxes, [KEY, "month"])
        .groupBy(KEY, "month", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def price_volume_pairs(df: DataFrame) -> DataFrame:
    """The points of a volume-price scatter: rows that have both."""
    return df.where(F.col("volume").isNotNull() & F.col("close").isNotNull()).select(KEY, TS, "volume", "close")


def price_volume_correlation(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("pairs"), F.corr("volume", "close").alias("corr"))


def autocorrelation(df: DataFrame, column: str, lags: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Autocorrelation at lags 0..lags with denominators n, and the half-width of its band.

    One pass for positions, length and mean, one for all lag products; only one row per series is
    shuffled after the lag columns.
    """
    rows = renumber_sized(df.select(KEY, POS, column).where(F.col(column).isNotNull()), {"_sum": column}, block_rows)
    centred = rows.select(KEY, POS, "n", (F.col(column) - F.col("_sum") / F.col("n")).alias("_d"))

    def add(t: DataFrame) -> DataFrame:
        return t.withColumn("_back", F.array(*[F.col("_d") * lagged("_d", k) for k in range(lags + 1)]))

    products = over_blocks(centred, add, behind=lags, block_rows=block_rows)
    sums = products.groupBy(KEY).agg(
        F.max("n").alias("n"), *[F.sum(F.col("_back")[k]).alias(f"_s{k}") for k in range(lags + 1)]
    )
    long = sums.select(
        KEY, "n", "_s0", F.posexplode(F.array(*[F.col(f"_s{k}") for k in range(lags + 1)])).alias("lag", "_s")
    ).withColumn("acf", F.try_divide("_s", "_s0"))
    # Bartlett's variance: (1 + 2 * sum of earlier squares) / n, at most ``lags`` rows per series.
    earlier = Window.partitionBy(KEY).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier), F.lit(0.0))
    band = F.when(F.col("lag") == 0, 0.0).otherwise(BAND_95 * F.sqrt((1 + 2 * squares) / F.col("n")))
    return long.select(KEY, "n", F.col("lag").cast("bigint").alias("lag"), "acf", band.alias("band"))


def partial_from_acf(rho: np.ndarray) -> np.ndarray:
    """Levinson-Durbin recursion: partial autocorrelations from autocorrelations (lag 0 first)."""
    out, phi, error = [1.0], np.zeros(0), 1.0
    for k in range(1, len(rho)):
        last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / error
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1.0 - last * last
        out.append(last)
    return np.asarray(out)


def partial_autocorrelation(df: DataFrame, column: str, lags: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Partial autocorrelations; the recursion sees ``lags + 1`` numbers per series."""

    def recursion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pd.DataFrame(
            {KEY: pdf[KEY], "lag": pdf["lag"], "pacf": partial_from_acf(pdf["acf"].to_numpy()),
             "band": np.where(pdf["lag"] == 0, 0.0, BAND_95 / np.sqrt(pdf["n"]))}
        )

    acf = autocorrelation(df, column, lags, block_rows)
    return acf.groupBy(KEY).applyInPandas(recursion, f"{KEY} string, lag bigint, pacf double, band double")


def seasonal_decompose(
    df: DataFrame, column: str, period: int, model: str = "additive", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Trend by centred moving average, normalised phase means, and the rest."""
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    additive = model == "additive"
    half = period // 2
    rows = renumber(df.select(KEY, TS, POS, column).where(F.col(column).isNotNull()), block_rows)

    def add(t: DataFrame) -> DataFrame:
        around = ordered().rowsBetween(-half, half)
        total = F.sum(column).over(around)
        if period % 2 == 0:  # both ends count half
            ends = F.lag(column, half).over(ordered()) + F.lead(column, half).over(ordered())
            total = total - ends / 2
        full = F.count(column).over(around) == 2 * half + 1
        return t.withColumn("trend", F.when(full, total / period))

    trended = over_blocks(rows, add, behind=half, ahead=half, block_rows=block_rows)
    free = (F.col(column) - F.col("trend")) if additive else F.try_divide(column, "trend")
    phased = trended.withColumns({"_phase": F.pmod(F.col(POS) - 1, F.lit(period)), "_free": free})
    means = phased.groupBy(KEY, "_phase").agg(F.avg("_free").alias("_raw"), F.max(POS).alias("_last"))
    overall = F.avg("_raw").over(Window.partitionBy(KEY))  # ``period`` rows per series
    seasons = means.select(
        KEY, "_phase", "_last", (F.col("_raw") - overall if additive else F.col("_raw") / overall).alias("_season")
    )
    # ``period`` values per series travel as one array, attached block by block.
    in_order = F.sort_array(F.collect_list(F.struct("_phase", "_season")))
    packed = seasons.groupBy(KEY).agg(
        F.transform(in_order, lambda s: s["_season"]).alias("_seasons"), F.max("_last").alias("n")
    )
    out = attach_series(phased, packed, block_rows=block_rows).withColumn(
        "seasonal", F.element_at("_seasons", (F.col("_phase") + 1).cast("int"))
    )
    rest = (
        F.col(column) - F.col("trend") - F.col("seasonal")
        if additive
        else F.try_divide(F.try_divide(column, "trend"), F.col("seasonal"))
    )
    return out.withColumn("resid", rest).select(KEY, TS, POS, column, "trend", "seasonal", "resid")


def ljung_box(df: DataFrame, column: str, lags: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Joint test of the first ``lags`` autocorrelations: statistic and p-value."""
    acf = autocorrelation(df, column, lags, block_rows)
    n = F.col("n")
    return (
        acf.where("lag > 0")
        .groupBy(KEY, "n")
        .agg(F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).alias("_q"))
        .select(KEY, F.lit(lags).cast("bigint").alias("lags"), (n * (n + 2) * F.col("_q")).alias("stat"))
        .withColumn("p_value", chi2_tail("stat", F.col("lags")))
    )


def normal_quantile_points(
    df: DataFrame, column: str, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Sorted values against normal quantiles at i / (n + 1), with the standardised line.

    Ranks come from counts per value range, not from one sorted task.
    """
    ranked = rank_by_value(df, column, block_rows, range_rows)
    moments = df.groupBy(KEY).agg(
        F.count(column).alias("n"), F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd")
    )
    sized = attach_series(ranked.withColumn(POS, F.col("rank")), moments, block_rows=block_rows)
    points = sized.withColumn("theoretical", normal_quantile(F.col("rank") / (F.col("n") + 1)))
    return points.select(
        KEY,
        "rank",
        "theoretical",
        F.col("value").alias("sample"),
        (F.col("_mean") + F.col("_sd") * F.col("theoretical")).alias("line"),
    )


def rank_by_value(df: DataFrame, column: str, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rank`` 1..n of each value in its series.

    Equal values are counted before they are shuffled; the distinct ones are sorted by ranges whose number follows the
    table's size, and a rank is the offset of the range plus the counts inside it.  The counted values unfold at the
    end, in chunks, so ties of any number stay one row until then.
    """
    values = df.where(F.col(column).isNotNull()).select(KEY, F.col(column).alias("value"))
    counted = stage(values.groupBy(KEY, "value").agg(F.count(F.lit(1)).alias("_c")), "distinct-values")
    ranked = running_counts(counted, [KEY], ["value"], "_c", range_rows)
    chunk = F.lit(block_rows).cast("bigint")
    return (
        ranked.withColumn("_start", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"), chunk)))
        .withColumn("rank", F.explode(F.sequence("_start", F.least(F.col("_start") + chunk - 1, F.col("_to")))))
        .select(KEY, "value", "rank")
    )
