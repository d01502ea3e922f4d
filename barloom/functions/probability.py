"""Tail probabilities for one-row-per-series results, as vectorised column functions, and the normal quantile as a plain
column expression for every row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Published response-surface coefficients for the unit-root test with a
# constant (MacKinnon 1994 for the p-value, MacKinnon 2010 for the critical values).
UNIT_ROOT_MIN = -18.83
UNIT_ROOT_MAX = 2.74
UNIT_ROOT_SWITCH = -1.61
UNIT_ROOT_SMALL_P = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
UNIT_ROOT_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# Rational approximations of the normal quantile (Wichura 1988, algorithm AS 241), numerator and denominator
# from the highest power down: for |p - 1/2| <= 0.425, for the tails up to sqrt(-ln p) = 5, and beyond.
QUANTILE_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
QUANTILE_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def normal_cdf_value(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def chi2_tail_value(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x): a finite sum over half of df, each term from its logarithm."""
    half = x / 2.0
    if half <= 0:
        return 1.0
    shift = 0.0 if df % 2 == 0 else 0.5
    powers = [j + shift for j in range(df // 2)]
    total = sum(math.exp(k * math.log(half) - half - math.lgamma(k + 1)) for k in powers)
    return min(1.0, total if df % 2 == 0 else math.erfc(math.sqrt(half)) + total)


def unit_root_p_value(stat: float) -> float:
    if stat > UNIT_ROOT_MAX:
        return 1.0
    if stat < UNIT_ROOT_MIN:
        return 0.0
    coefficients = UNIT_ROOT_SMALL_P if stat <= UNIT_ROOT_SWITCH else UNIT_ROOT_LARGE_P
    return normal_cdf_value(sum(c * stat**k for k, c in enumerate(coefficients)))


def unit_root_critical(level: str, n: int) -> float:
    return sum(c / n**k for k, c in enumerate(UNIT_ROOT_CRITICAL[level]))


@pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(normal_cdf_value, na_action="ignore").astype("float64")


def _ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    def polynomial(values: tuple[float, ...]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * r + v
        return out

    return polynomial(coefficients[0]) / polynomial(coefficients[1])


def normal_quantile(p: Column) -> Column:
    """The normal quantile of ``p``, to about 16 digits; null outside (0, 1)."""
    q = p - 0.5
    far = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(far <= 5, _ratio(QUANTILE_TAIL, far - 1.6)).otherwise(_ratio(QUANTILE_FAR, far - 5))
    middle = q * _ratio(QUANTILE_MIDDLE, 0.180625 - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -tail).otherwise(tail)))


@pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail_value(a, int(k)) for a, k in zip(x, df)], dtype="float64")
