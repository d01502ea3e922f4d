"""ARIMA-style forecasts: two-stage least squares (Hannan and Rissanen 1982), then least conditional squares.

The first fit comes from summed cross-products.  With error terms it is where Gauss-Newton steps start that lower the conditional
sum of squares: errors and their derivatives are one filter of the block's rows, started far enough before it, and a step
needs only their summed cross-products.  A series of one block is fitted inside its task, longer ones in rounds.

Parameters are fitted once; every walk-forward step applies them to its own history window, so steps are rows.  A forecast
under fixed parameters is linear in the logs of its history: its weights are worked out once per series and order, and Spark
multiplies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import HOLD_THRESHOLD
from barloom.operators.datasets import FIRST_FIT, REFIT
from barloom.operators.forecasters import final_forecast
from barloom.operators.linear import cross_products, least_squares, solve, square
from barloom.operators.metrics import direction_hit, mape_of
from barloom.operators.ordered import from_split, lagged
from barloom.plans.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEY,
    POS,
    TS,
    attach_series,
    by_block,
    ordered,
    over_blocks,
    series_length,
    spread,
)
from barloom.plans.staging import stage

_FIT = f"{KEY} string, p int, d int, q int, const double, phi array<double>, theta array<double>"
LONG_LAGS = 20
EDGE = 0.999  # largest inverse root of the error weights

Order = tuple[int, int, int]


def check_order(order: Order) -> None:
    if not (isinstance(order, tuple) and len(order) == 3 and all(isinstance(v, int) and v >= 0 for v in order)):
        raise ValueError("an order is a tuple (p, d, q) of numbers from 0")


def _differenced(df: DataFrame, column: str, d: int, fit_splits: tuple[str, ...], block_rows: int) -> DataFrame:
    """``y``: the d-th difference of the log; null outside the rows used for fitting."""

    def add(t: DataFrame) -> DataFrame:
        t = t.withColumn("_y0", F.log(column))
        for k in range(d):
            t = t.withColumn(f"_y{k + 1}", F.col(f"_y{k}") - lagged(f"_y{k}"))
        return t.withColumn("y", F.when(F.col("split").isin(*fit_splits), F.col(f"_y{d}"))).drop(
            *[f"_y{k}" for k in range(d + 1)]
        )

    return over_blocks(df.select(KEY, TS, POS, "split", column), add, behind=max(d, 1), block_rows=block_rows)


def _with_lags(df: DataFrame, column: str, lags: int, block_rows: int) -> DataFrame:
    return over_blocks(
        df,
        lambda t: t.withColumns({f"{column}_{k}": lagged(column, k) for k in range(1, lags + 1)}),
        behind=lags,
        block_rows=block_rows,
    )


def design(
    df: DataFrame, column: str, d: int, p: int, q: int, fit_splits: tuple[str, ...] = ("train",),
    long_lags: int = LONG_LAGS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``y``, its lags ``y_1..y_p`` and the lags ``e_1..e_q`` of the residuals of a long autoregression."""
    y = _differenced(df, column, d, fit_splits, block_rows)
    if q == 0:
        return _with_lags(y, "y", p, block_rows).na.drop(subset=["y"])
    deep = max(long_lags, p)
    lagged_y = _with_lags(y, "y", deep, block_rows)
    names = [f"y_{k}" for k in range(1, deep + 1)]
    first = least_squares(lagged_y, "y", names, intercept=d == 0).select(KEY, F.col("coefficients").alias("_long"))
    # The long fit has one row per series; it is attached block by block.
    sized = series_length(df).join(first, KEY)
    shift = 1 if d == 0 else 0
    fitted = F.lit(0.0) if d else F.col("_long")[0]
    for i, name in enumerate(names):
        fitted = fitted + F.col("_long")[i + shift] * F.col(name)
    residual = attach_series(lagged_y, sized, block_rows=block_rows).withColumn("e", F.col("y") - fitted)
    return _with_lags(residual.drop("_long", "n"), "e", q, block_rows).na.drop(subset=["y"])


def fit_orders(
    df: DataFrame, column: str, orders: list[Order], fit_splits: tuple[str, ...] = ("train",),
    long_lags: int = LONG_LAGS, block_rows: int = BLOCK_ROWS, refine: bool = True,
) -> DataFrame:
    """Coefficients of every order, one row per series and order: ``const`` (0 when differenced), ``phi``, ``theta``.

    First fits come from one cross-product table per difference; ``refine`` lowers the sum of squares of orders with error
    terms from there.  Without error terms the first fit has the least sum already.
    """
    for order in orders:
        check_order(order)
    out = None
    for d in sorted({o[1] for o in orders}):
        chosen = [o for o in orders if o[1] == d]
        p, q = max(o[0] for o in chosen), max(o[2] for o in chosen)
        names = [f"y_{k}" for k in range(1, p + 1)] + [f"e_{k}" for k in range(1, q + 1)]
        rows = design(df, column, d, p, q, fit_splits, long_lags, block_rows).na.drop(subset=["y", *names])
        grams = cross_products(
            rows.select(KEY, F.array(F.lit(1.0), *[F.col(c) for c in names], F.col("y")).alias("row"))
        )
        fitted = grams.mapInPandas(
            _order_solver(chosen, p, q),
            _FIT,
        )
        if refine and q:
            values = stage(_differenced(df, column, d, fit_splits, block_rows).select(KEY, POS, "y"), "differences")
            fitted = least_conditional_squares(values, fitted, block_rows)
        out = fitted if out is None else out.unionByName(fitted)
    return out


def _order_solver(orders: list[Order], p_max: int, q_max: int):
    def fit(batches):
        for pdf in batches:
            rows = []
            for key, flat in zip(pdf[KEY], pdf["gram"]):
                gram = square(flat)
                y = 1 + p_max + q_max
                for p, d, q in orders:
                    xs = ([0] if d == 0 else []) + list(range(1, p + 1)) + list(range(1 + p_max, 1 + p_max + q))
                    beta = solve(gram, xs, y)[0] if xs else np.zeros(0)
                    const = float(beta[0]) if d == 0 else 0.0
                    beta = beta[1:] if d == 0 else beta
                    rows.append((key, p, d, q, const, beta[:p].tolist(), invertible(beta[p:]).tolist()))
            yield pd.DataFrame(rows, columns=[KEY, "p", "d", "q", "const", "phi", "theta"])

    return fit


def invertible(theta: np.ndarray) -> np.ndarray:
    """Error weights with the same autocorrelations whose errors die out: inverse roots outside the circle are
    reflected, and none is larger than ``EDGE``."""
    roots = np.roots(np.r_[1.0, theta]).astype(complex)
    size = np.abs(roots)
    if not (size > EDGE).any():
        return theta
    roots = np.where(size > 1, roots / np.maximum(size, 1.0) ** 2, roots)
    roots = roots * np.minimum(1.0, EDGE / np.maximum(np.abs(roots), EDGE))
    return np.poly(roots)[1:].real


# ------------------------------------------------------- least conditional squares

ROUNDS = 25
_SETTLED = 1e-12  # relative gain below which the sum of squares has settled
_FADED = 1e-16  # weight of an error that no longer counts
FADE_ROWS = int(np.ceil(np.log(_FADED) / np.log(EDGE)))
_STATE = f"{_FIT}, sse double, normal array<double>, slope array<double>, damping double, beta array<double>, done boolean"


def _response(theta: np.ndarray, rows: int) -> np.ndarray:
    """Weights of this and earlier surprises in an error, until they fade."""
    q, h = len(theta), [1.0]
    while len(h) < rows:
        h.append(-float(sum(t * v for t, v in zip(theta, h[: -q - 1 : -1]))))
        if max(abs(v) for v in h[-q:]) < _FADED:
            break
    return np.array(h)


def _filtered(columns: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Causal convolution of each row of ``columns``."""
    n = columns.shape[1]
    size = 1 << (n + len(response) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(columns, size) * np.fft.rfft(response, size), size)[:, :n]


def conditional_sums(y: np.ndarray, own: np.ndarray, with_const: bool, p: int, beta: np.ndarray):
    """Sum of squared errors over the rows marked ``own``, and ``J'J`` and ``J'e`` of the errors' derivatives.

    ``beta``: constant (if ``with_const``), ``p`` lag weights, error weights.  Errors before the rows count as 0, and so do
    surprises of rows of which a lag is missing.
    """
    n, c = len(y), int(with_const)
    lags = np.full((p + 1, n), np.nan)
    for i in range(min(p, n - 1) + 1):
        lags[i, i:] = y[: n - i]
    valid = ~np.isnan(lags).any(axis=0)
    lags[:, ~valid] = 0.0
    regressors = np.vstack([valid.astype(float)[None, :]][:c] + [lags[1:]]) if c or p else np.zeros((0, n))
    theta = beta[c + p :]
    surprise = lags[0] - beta[: c + p] @ regressors
    response = _response(theta, n)
    filtered = _filtered(np.vstack([surprise[None, :], regressors]), response)
    e, again = filtered[0], _filtered(filtered[:1], response)[0]
    slopes = [-row for row in filtered[1:]] + [-np.r_[np.zeros(min(j, n)), again[: max(n - j, 0)]] for j in range(1, len(theta) + 1)]
    at = valid & own
    j, e = np.vstack(slopes)[:, at], e[at]
    return float(e @ e), j @ j.T, j @ e


def _beta(d: int, const: float, phi, theta) -> np.ndarray:
    return np.r_[[const] if d == 0 else [], np.asarray(phi, dtype=float), np.asarray(theta, dtype=float)]


def _step(beta: np.ndarray, normal: np.ndarray, slope: np.ndarray, damping: float, q: int) -> np.ndarray:
    """A damped Gauss-Newton step; the errors of the result die out."""
    scale = np.sqrt(np.maximum(np.diag(normal), 1e-300))
    scaled = normal / np.outer(scale, scale) + damping * np.eye(len(beta))
    new = beta - np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) @ (slope / scale) / scale
    return np.r_[new[:-q], invertible(new[-q:])]


class _Descent:
    """Accepted parameters of one series and order, and the next to try."""

    def __init__(self, p, d, q, beta, sse=None, normal=None, slope=None, damping=1e-4, trial=None, done=False):
        self.p, self.d, self.q, self.damping, self.done = p, d, q, damping, done
        self.beta, self.trial = np.asarray(beta), np.asarray(beta if trial is None else trial)
        k = len(self.beta)
        self.sse, self.normal, self.slope = sse, None if normal is None else np.reshape(normal, (k, k)), None if slope is None else np.asarray(slope)

    def tried(self, sse: float, normal: np.ndarray, slope: np.ndarray) -> None:
        if self.sse is None or sse < self.sse:
            self.done = self.sse is not None and self.sse - sse <= _SETTLED * self.sse
            self.beta, self.sse, self.normal, self.slope = self.trial, sse, normal, slope
            self.damping = max(self.damping / 5, 1e-12)
        else:
            self.damping = max(self.damping * 10, 1e-6)
            self.done = self.damping > 1e6
        if not self.done:
            self.trial = _step(self.beta, self.normal, self.slope, self.damping, self.q)

    def row(self, key: str) -> tuple:
        c = int(self.d == 0)
        phi, theta = self.beta[c : c + self.p].tolist(), self.beta[c + self.p :].tolist()
        fit = (key, self.p, self.d, self.q, float(self.beta[0]) if c else 0.0, phi, theta)
        return (*fit, self.sse, self.normal.ravel().tolist(), self.slope.tolist(), self.damping, self.trial.tolist(), self.done)


_STATE_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _descent(r) -> _Descent:
    beta = _beta(int(r.d), r.const, r.phi, r.theta)
    return _Descent(int(r.p), int(r.d), int(r.q), beta, float(r.sse), np.asarray(r.normal), r.slope, float(r.damping), r.beta, bool(r.done))


def least_conditional_squares(values: DataFrame, fits: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``fits`` with the conditional sum of squares of ``y`` in the staged table ``values`` lowered until it settles.

    A block is read from ``FADE_ROWS`` rows before it, when the errors left out have faded.
    """
    plain, moving = fits.where("q = 0"), fits.where("q > 0")
    longest = values.agg(F.max(POS)).first()[0] or 0  # one number
    if longest <= block_rows:
        both = values.groupBy(KEY).cogroup(moving.groupBy(KEY))
        return both.applyInPandas(lambda y, f: _fit_in_task(y, f, rounds), _FIT).unionByName(plain)
    spread_ = stage(spread(values, FADE_ROWS, block_rows=block_rows), "difference-blocks")
    blocks = by_block(values.groupBy(KEY).agg(F.max(POS).alias("n")), "n", block_rows).select(KEY, BLOCK)
    state = stage(moving, "first-fits")
    for turn in range(rounds):
        trials = state if turn == 0 else state.where("NOT done")
        sums = spread_.groupBy(KEY, BLOCK).cogroup(trials.join(blocks, KEY).groupBy(KEY, BLOCK)).applyInPandas(
            lambda y, f: _block_sums(y, f, block_rows), f"{KEY} string, p int, q int, i int, v double"
        )
        sums = sums.groupBy(KEY, "p", "q", "i").agg(F.sum("v").alias("v"))
        sums = sums.groupBy(KEY, "p", "q").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
        stepped = trials.join(sums, [KEY, "p", "q"]).mapInPandas(_stepped, _STATE)
        state = stage(stepped if turn == 0 else stepped.unionByName(state.where("done")), "fits")
        if state.where("NOT done").isEmpty():
            break
    return state.select(KEY, "p", "d", "q", "const", "phi", "theta").unionByName(plain)


def _fit_in_task(y: pd.DataFrame, fits: pd.DataFrame, rounds: int) -> pd.DataFrame:
    values, rows = _in_place(y), []
    for r in fits.itertuples(index=False):
        descent = _Descent(int(r.p), int(r.d), int(r.q), _beta(int(r.d), r.const, r.phi, r.theta))
        for _ in range(rounds):
            if descent.done or not len(values):
                break
            descent.tried(*conditional_sums(values, np.ones(len(values), dtype=bool), r.d == 0, descent.p, descent.trial))
        c = int(r.d == 0)
        rows.append((r.series_id, r.p, r.d, r.q, float(descent.beta[0]) if c else 0.0, descent.beta[c : c + descent.p], descent.beta[c + descent.p :]))
    return pd.DataFrame(rows, columns=_STATE_NAMES[:7])


def _in_place(y: pd.DataFrame) -> np.ndarray:
    """Values by position from the first to the last, missing rows as NaN; rows after the last value are left out."""
    known = y[y["y"].notna()]
    if known.empty:
        return np.zeros(0)
    first = y[POS].min()
    out = np.full(int(known[POS].max() - first) + 1, np.nan)
    out[(known[POS] - first).to_numpy()] = known["y"].to_numpy()
    return out


def _block_sums(y: pd.DataFrame, fits: pd.DataFrame, block_rows: int) -> pd.DataFrame:
    values, parts = _in_place(y), []
    if not len(values) or fits.empty:
        return pd.DataFrame(columns=[KEY, "p", "q", "i", "v"])
    own = (np.arange(len(values)) + y[POS].min() - 1) // block_rows == y[BLOCK].iloc[0]
    for r in fits.itertuples(index=False):
        beta = _beta(int(r.d), r.const, r.phi, r.theta) if "beta" not in fits else np.asarray(r.beta)
        sse, normal, slope = conditional_sums(values, own, r.d == 0, int(r.p), beta)
        flat = np.r_[sse, normal.ravel(), slope]
        parts.append(pd.DataFrame({KEY: r.series_id, "p": r.p, "q": r.q, "i": np.arange(len(flat), dtype="int32"), "v": flat}))
    return pd.concat(parts)


def _stepped(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            descent = _descent(r) if "sse" in pdf else _Descent(int(r.p), int(r.d), int(r.q), _beta(int(r.d), r.const, r.phi, r.theta))
            k = len(descent.beta)
            sums = np.asarray(r.sums)
            descent.tried(float(sums[0]), sums[1 : 1 + k * k].reshape(k, k), sums[1 + k * k :])
            rows.append(descent.row(r.series_id))
        yield pd.DataFrame(rows, columns=_STATE_NAMES)


def memory(p: int, d: int, theta: np.ndarray) -> int:
    """Rows of history after which an error's weight is below 1e-30; ``EDGE`` bounds it to some 70,000."""
    reach = p + d + len(theta) + 1
    size = np.abs(np.roots(np.r_[1.0, theta])).max(initial=0.0)
    return reach if size < 1e-30 else reach + int(np.ceil(np.log(1e-30) / np.log(min(size, EDGE))))


def forecast_weights(
    rows: int, d: int, const: float, phi: np.ndarray, theta: np.ndarray, steps: int
) -> tuple[float, np.ndarray] | None:
    """``c`` and ``w`` (oldest row first) that make ``c + w @ logs`` the forecast ``steps`` ahead of ``rows`` log values.

    With fixed parameters the forecast is linear in its history.  Errors before the history and of its first ``p`` rows
    count as 0.  Nothing if the history is shorter than the order needs.
    """
    p, q, m = len(phi), len(theta), rows - d
    if m < max(p, 1):
        return None
    # the recursion on unit vectors: constant, last p values, last q errors, last level of each difference
    unit = np.eye(1 + p + q + d)
    ys, es, totals = list(unit[1 : 1 + p]), list(unit[1 + p : 1 + p + q]), list(unit[1 + p + q :])
    for _ in range(steps):
        value = const * unit[0] + sum(f * y for f, y in zip(phi, ys)) + sum(t * e for t, e in zip(theta, es))
        ys, es = [value, *ys][:p], [0 * value, *es][:q]
        for k in range(d - 1, -1, -1):  # add differences up to the level
            value = totals[k] = totals[k] + value
    c, w = float(value[0]), np.zeros(m)
    w[m - p :] += value[1 : 1 + p][::-1]
    # an error is its row's surprise less the weighted errors before it: collect each surprise's weight from the end
    g = np.zeros(m + q)
    g[max(m - q, 0) : m] = value[1 + p : 1 + p + q][::-1][-m:] if q else 0.0
    if q:
        for t in range(m - 1, p - 1, -1):
            g[t] -= theta @ g[t + 1 : t + 1 + q]
    g = g[p:m]
    w[p:] += g
    for i, f in enumerate(phi):
        w[p - 1 - i : m - 1 - i] -= f * g
    c -= const * float(g.sum())
    for k in range(d - 1, -1, -1):
        w = np.r_[0.0, w] - np.r_[w, 0.0]
        w[-1] += value[1 + p + q + k]
    return c, w


def _parameters(pdf: pd.DataFrame):
    for r in pdf.itertuples(index=False):
        yield r, (int(r.d), float(r.const), np.asarray(r.phi, dtype=float), np.asarray(r.theta, dtype=float))


def window_weights(coefficients: DataFrame, window: int, steps: int) -> DataFrame:
    """``(series_id, p, d, q, shift, weights)``: the forecast from a window of logs as one dot product."""

    def weigh(batches):
        for pdf in batches:
            out = [(r.series_id, r.p, r.d, r.q, forecast_weights(window, *given, steps)) for r, given in _parameters(pdf)]
            rows = [(*head, w[0], w[1].tolist()) for *head, w in out if w is not None]
            yield pd.DataFrame(rows, columns=[KEY, "p", "d", "q", "shift", "weights"])

    return coefficients.mapInPandas(weigh, f"{KEY} string, p int, d int, q int, shift double, weights array<double>")


def history_weights(coefficients: DataFrame, lengths: DataFrame, steps: int) -> DataFrame:
    """``(series_id, pos, shift, weight)``: weights of the rows at the end of each series that a forecast from its whole
    history needs; earlier rows weigh nothing.  ``coefficients`` has one order per series."""

    def weigh(batches):
        for pdf in batches:
            for r, given in _parameters(pdf):
                rows = min(int(r.n), memory(int(r.p), int(r.d), given[3]))
                found = forecast_weights(rows, *given, steps)
                if found is not None:
                    at = np.arange(r.n - rows + 1, r.n + 1)
                    yield pd.DataFrame({KEY: r.series_id, POS: at, "shift": found[0], "weight": found[1]})

    return coefficients.join(lengths, KEY).mapInPandas(weigh, f"{KEY} string, {POS} long, shift double, weight double")


def _windows(df: DataFrame, column: str, window: int, h: int, split: str, block_rows: int) -> DataFrame:
    """History of ``window`` log values ending one row before the base row, base and truth."""

    def add(t: DataFrame) -> DataFrame:
        o = ordered()
        logs = F.collect_list(F.log(column)).over(o.rowsBetween(-window, -1))
        return t.withColumns(
            {
                "logs": F.when(F.size(logs) == window, logs),
                "_ts": F.lead(TS, h).over(o),
                "_pos": F.lead(POS, h).over(o),
                "true": F.lead(column, h).over(o),
                "_split": F.lead("split", h).over(o),
            }
        )

    near = from_split(df.select(KEY, TS, POS, "split", column), split, window, block_rows)
    steps = over_blocks(near, add, behind=window, ahead=h, block_rows=block_rows)
    kept = (F.col("split") == split) & (F.col("_split") == split) & F.col("logs").isNotNull()
    return steps.where(kept).select(
        KEY, F.col("_ts").alias(TS), F.col("_pos").alias(POS), "logs", "true", F.col(column).alias("base")
    )


def backtest_orders(
    df: DataFrame, column: str, coefficients: DataFrame, window: int, h: int, split: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Predictions of every fitted order: fixed parameters, rolling window, ``h + 1`` steps ahead of
    the last known row.  A prediction is the dot product of its window and the order's weights."""
    struct = F.struct("p", "d", "q", "shift", "weights")
    weights = window_weights(coefficients, window, h + 1)
    packed = weights.groupBy(KEY).agg(F.sort_array(F.collect_list(struct)).alias("orders"))
    sized = series_length(df).join(packed, KEY)
    rows = attach_series(_windows(df, column, window, h, split, block_rows), sized, block_rows=block_rows)
    dot = "aggregate(zip_with(logs, o.weights, (x, w) -> x * w), 0D, (a, v) -> a + v)"
    each = f"inline(transform(orders, o -> struct(o.p AS p, o.d AS d, o.q AS q, exp(o.shift + {dot}) AS pred)))"
    return rows.selectExpr(KEY, TS, POS, "`true`", "base", each).select(
        KEY, F.concat(F.lit("ar("), F.concat_ws(",", "p", "d", "q"), F.lit(")")).alias("model"),
        TS, POS, "true", "pred", "base", "p", "d", "q",
    )


def ar_backtest(
    df: DataFrame, order: Order, window: int, h: int, split: str = "test", fit_splits: tuple[str, ...] | None = None,
    column: str = "close", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Walk-forward predictions of one order, fitted on the splits before the one that is predicted."""
    fit_splits = fit_splits or (REFIT if split == "test" else FIRST_FIT)
    fitted = fit_orders(df, column, [order], fit_splits, block_rows=block_rows)
    return backtest_orders(df, column, fitted, window, h, split, block_rows).drop("p", "d", "q")


def order_search(
    df: DataFrame, orders: list[Order], window: int, h: int, split: str = "valid", column: str = "close",
    block_rows: int = BLOCK_ROWS, refine: bool = False,
) -> DataFrame:
    """Scores of all orders on the validation rows, highest direction first, then lowest MAPE.

    Orders are compared by their first fits, which all come from one table, unless ``refine`` fits each to the end.

    Orders with one ``d`` are fitted on the same rows, those with all lags of the longest, so that they compare; fit the
    winner alone to use all of its own rows.
    """
    fitted = fit_orders(df, column, orders, block_rows=block_rows, refine=refine)
    predictions = backtest_orders(df, column, fitted, window, h, split, block_rows)
    return (
        predictions.groupBy(KEY, "model", "p", "d", "q")
        .agg(mape_of().alias("mape"), (F.avg(direction_hit().cast("double")) * 100).alias("da"))
        .orderBy(KEY, F.col("da").desc(), "mape", "model")
    )


def ar_forecast(
    df: DataFrame, order: Order, h: int, freq: str, hold: float = HOLD_THRESHOLD, column: str = "close",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Refit on all rows and forecast h rows past the end of each series from its whole history; null if one of the
    rows that count has no value."""
    fitted = fit_orders(df, column, [order], ("train", "valid", "test"), block_rows=block_rows)
    weights = history_weights(fitted, series_length(df), h)
    logs = df.select(KEY, POS, F.log(column).alias("_log"))
    sums = weights.join(logs, [KEY, POS], "left").groupBy(KEY).agg(
        F.when(F.count("_log") == F.count("weight"), F.exp(F.sum(F.col("weight") * F.col("_log")) + F.first("shift"))).alias("pred")
    )
    return final_forecast(sums, df, h, freq, hold)
