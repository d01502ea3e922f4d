"""Scalar expressions.  Division is null-safe: ANSI mode raises on x / 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RSI zone edges and their labels.
RSI_LOW = 30.0
RSI_HIGH = 70.0
RSI_TOP = 100.0
RSI_LABELS = ("Oversold", "Neutral", "Overbought")

# Fixed value: relative move below which a forecast means "hold".
HOLD_THRESHOLD = 0.005


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def range_pct(high="high", low="low", open_="open") -> Column:
    """Bar range as a share of the opening price."""
    return F.try_divide(_c(high) - _c(low), _c(open_))


def log_value(x) -> Column:
    return F.log(_c(x))


def log1p_value(x) -> Column:
    return F.log1p(_c(x))


def finite_or_null(x) -> Column:
    """NaN and both infinities become null."""
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def zero_flag(x) -> Column:
    """1 where the value is exactly 0, else 0 (also for null)."""
    return F.coalesce(_c(x) == 0, F.lit(False)).cast("int")


def crossover(fast, slow) -> Column:
    """1 where fast > slow, else 0 (also for null)."""
    return F.coalesce(_c(fast) > _c(slow), F.lit(False)).cast("int")


def rsi_state(x) -> Column:
    """Right-open zones; a value of exactly 100 (or outside 0..100) has no zone."""
    c = _c(x)
    return (
        F.when((c >= 0) & (c < RSI_LOW), RSI_LABELS[0])
        .when((c >= RSI_LOW) & (c < RSI_HIGH), RSI_LABELS[1])
        .when((c >= RSI_HIGH) & (c < RSI_TOP), RSI_LABELS[2])
    )


def direction_signal(value, base, hold: float = HOLD_THRESHOLD) -> Column:
    """1 up, -1 down, 0 hold, by relative move from ``base``; by sign when the base is 0."""
    v, b = _c(value), _c(base)
    move = F.try_divide(v - b, b)
    return F.when(b == 0, F.signum(v - b)).otherwise(
        F.when(move > hold, 1.0).when(move < -hold, -1.0).otherwise(0.0)
    )


def future_time(ts, steps: int, freq: str) -> Column:
    """The label ``steps`` bars after ``ts`` (zone-less timestamp)."""
    c = _c(ts)
    units = {"min": "MINUTE", "h": "HOUR", "D": "DAY"}
    if freq in units:
        return c + F.expr(f"INTERVAL '{int(steps)}' {units[freq]}")
    if freq == "W":
        return c + F.expr(f"INTERVAL '{7 * int(steps)}' DAY")
    if freq == "ME":
        return F.last_day(F.add_months(F.to_date(c), int(steps))).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def future_label(ts, steps: int, freq: str) -> Column:
    return F.date_format(future_time(ts, steps, freq), "yyyy-MM-dd")


def price_from_log_return(base, scaled, mean, std) -> Column:
    """Undo the scaling of a predicted log return and apply it to the base price."""
    return _c(base) * F.exp(_c(scaled) * _c(std) + _c(mean))


def month_key(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "month")
