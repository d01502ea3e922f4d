"""Descriptions, distributions, time correlation and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.operators import forecasters, metrics, stats
from barloom.operators import tests_of_series as tests
from barloom.operators.joins import union_splits
from barloom.plans import tables as T
from barloom.plans.blocks import KEY, POS
from barloom.functions.probability import UNIT_ROOT_CRITICAL
from barloom.plans.flows import residual_panel
from barloom.plans.staging import stage
from barloom.queries import sqlparts as S

H = 7
BASES = ["persistence", "mean_7", "mean_30"]


def test_predictions(spark, sf_dir, split="test"):
    """Three deterministic forecasters on one split of the daily bars, staged."""
    s = T.daily_split(spark, sf_dir)
    parts = [forecasters.persistence(s, H, split)] + [forecasters.trailing_mean(s, H, n, split) for n in (7, 30)]
    return stage(union_splits(*parts), "predictions")


PRED = f"{S.DAILY_SPLIT}, {S.predictions(H, 'test')}"


def _describe(c: str) -> str:
    return f"""SELECT series_id, '{c}' AS "column", 'double' AS dtype, count({c}) AS "count", avg({c}) AS mean,
  stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM h GROUP BY series_id"""


@query(
    "describe_exact",
    "series_id column dtype count:i mean:6 std:6 min:4 q25:4 q50:4 q75:4 max:4",
    f"WITH {S.HOURLY} " + " UNION ALL ".join(_describe(c) for c in ("close", "volume")),
)
def describe_exact(spark, sf_dir):
    return stats.describe_exact(stage(T.hourly(spark, sf_dir), "hourly"), ["close", "volume"])


def _histogram_sql(source: str, x: str, bins: int) -> str:
    return f"""SELECT series_id, i AS bin, mn + i * width AS "left", mn + i * width + width AS "right", count(*) FILTER (bin = i) AS "count",
  count(*) FILTER (bin = i) / (max(n) * width) AS density FROM (
    SELECT series_id, mn, width, n, least(CAST(floor(({x} - mn) / width) AS BIGINT), {bins - 1}) AS bin FROM (
      SELECT series_id, {x}, min({x}) OVER (PARTITION BY series_id) AS mn, count({x}) OVER (PARTITION BY series_id) AS n,
        (max({x}) OVER (PARTITION BY series_id) - min({x}) OVER (PARTITION BY series_id)) / {bins} AS width
      FROM {source} WHERE {x} IS NOT NULL) AS a) AS b, range(0, {bins}) AS r(i)
  GROUP BY series_id, i, mn, width"""


_HIST = "series_id bin:i left:6 right:6 count:i density:9"


@query("histogram", _HIST, f"WITH {S.HOURLY} {_histogram_sql('h', 'close', 50)}")
def histogram(spark, sf_dir):
    return stats.histogram(stage(T.hourly(spark, sf_dir), "hourly"), "close", 50)


@query(
    "histogram_log1p",
    _HIST,
    f"WITH {S.DAILY}, l AS (SELECT series_id, ln(1 + close) AS x FROM d) {_histogram_sql('l', 'x', 50)}",
)
def histogram_log1p(spark, sf_dir):
    rows = T.daily(spark, sf_dir).select(KEY, POS, F.log1p("close").alias("x"))
    return stats.histogram(stage(rows, "log-close"), "x", 50)


@query(
    "kde",
    "series_id point:i x:6 density:9",
    f"""WITH {S.HOURLY}, a AS (SELECT series_id, min(close) AS mn, max(close) AS mx, count(close) AS m,
    stddev_samp(close) * pow(count(close), -0.2) AS bw FROM h GROUP BY 1),
    g AS (SELECT a.*, i AS point, mn + i * ((mx - mn) / 199) AS x FROM a, range(0, 200) AS r(i))
    SELECT g.series_id, point, x, sum(exp(-pow((x - close) / bw, 2) / 2)) / (any_value(m) * any_value(bw) * sqrt(2 * pi())) AS density
    FROM g JOIN h ON h.series_id = g.series_id GROUP BY g.series_id, point, x""",
)
def kde(spark, sf_dir):
    return stats.kernel_density(stage(T.hourly(spark, sf_dir), "hourly"), "close", 200)


def _box_sql(x: str) -> str:
    inside = f"{x} >= q1 - (q3 - q1) * 1.5 AND {x} <= q3 + (q3 - q1) * 1.5"
    return f"""WITH {S.DAILY}, x AS (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS month FROM d),
    b AS (SELECT series_id, month, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
      quantile_cont({x}, 0.75) AS q3 FROM x GROUP BY 1, 2)
    SELECT b.series_id, b.month, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
    min({x}) FILTER ({inside}) AS whisker_low, max({x}) FILTER ({inside}) AS whisker_high, count(*) FILTER (NOT ({inside})) AS outliers
    FROM x JOIN b ON b.series_id = x.series_id AND b.month = x.month GROUP BY 1, 2"""


_BOX = "series_id month:d q1:4 median:4 q3:4 whisker_low:4 whisker_high:4 outliers:i"


@query("monthly_box_stats", _BOX, _box_sql("close"))
def monthly_box_stats(spark, sf_dir):
    return stats.monthly_box_stats(stage(T.daily(spark, sf_dir), "daily"), "close")


@query("monthly_box_stats_volume", _BOX, _box_sql("volume"))
def monthly_box_stats_volume(spark, sf_dir):
    return stats.monthly_box_stats(stage(T.daily(spark, sf_dir), "daily"), "volume")


@query("price_volume_pairs", "series_id ts:t volume:4 close:4", f"WITH {S.HOURLY} SELECT series_id, ts, volume, close FROM h")
def price_volume_pairs(spark, sf_dir):
    return stats.price_volume_pairs(T.event_bars(spark, sf_dir, "h"))


@query(
    "price_volume_correlation",
    "series_id pairs:i corr:6",
    f"WITH {S.HOURLY} SELECT series_id, count(*) AS pairs, corr(volume, close) AS corr FROM h GROUP BY 1",
)
def price_volume_correlation(spark, sf_dir):
    return stats.price_volume_correlation(T.event_bars(spark, sf_dir, "h"))


def _acf_sql(source: str, x: str, lags: int) -> str:
    """CTEs r (numbered), c (centred), acf."""
    return f"""r AS (SELECT series_id, {x} AS x, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS k FROM {source}
  WHERE {x} IS NOT NULL),
c AS (SELECT series_id, k, x - avg(x) OVER (PARTITION BY series_id) AS dev, count(*) OVER (PARTITION BY series_id) AS n FROM r),
z AS (SELECT series_id, sum(dev * dev) AS s0 FROM c GROUP BY 1),
lagsum AS (SELECT a.series_id, any_value(a.n) AS n, l.i AS lag, sum(a.dev * b.dev) AS s FROM c AS a, range(0, {lags + 1}) AS l(i), c AS b
  WHERE b.series_id = a.series_id AND b.k = a.k - l.i GROUP BY a.series_id, l.i),
acf AS (SELECT lagsum.series_id, n, lag, s / s0 AS acf FROM lagsum JOIN z ON z.series_id = lagsum.series_id)"""


@query(
    "acf",
    "series_id lag:i acf:8 band:8",
    f"""WITH {S.HOURLY}, {_acf_sql('h', 'close', 40)} SELECT series_id, lag, acf, CASE WHEN lag = 0 THEN 0 ELSE
    1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER
    (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS band FROM acf""",
)
def acf(spark, sf_dir):
    return stats.autocorrelation(stage(T.hourly(spark, sf_dir), "hourly"), "close", 40)


def _pacf_sql(lags: int) -> str:
    """CTE pacf from acf: one row a lag, each extends the coefficients of the lag before."""
    return f"""rho AS (SELECT series_id, any_value(n) AS n, list(acf ORDER BY lag) AS r FROM acf GROUP BY 1),
ld AS (SELECT series_id, n, r, 0 AS lag, CAST(1 AS DOUBLE) AS pacf, CAST([] AS DOUBLE[]) AS phi FROM rho
  UNION ALL SELECT series_id, n, r, lag + 1, v, list_append(list_transform(range(1, lag + 1), lambda i: phi[i] - v * phi[lag + 1 - i]), v)
  FROM (SELECT *, (r[lag + 2] - coalesce(list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[lag + 2 - i])), 0))
    / (1 - coalesce(list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[i + 1])), 0)) AS v FROM ld WHERE lag < {lags}) AS step),
pacf AS (SELECT series_id, lag, pacf, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 / sqrt(n) END AS band FROM ld)"""


@query("pacf", "series_id lag:i pacf:8 band:8", f"WITH RECURSIVE {S.HOURLY}, {_acf_sql('h', 'close', 40)}, {_pacf_sql(40)} SELECT * FROM pacf")
def pacf(spark, sf_dir):
    return stats.partial_autocorrelation(stage(T.hourly(spark, sf_dir), "hourly"), "close", 40)


def _decompose_sql(period: int, additive: bool) -> str:
    half = period // 2
    full = S.rows(half, half)
    ends = f" - (lag(close, {half}) OVER {S.W} + lead(close, {half}) OVER {S.W}) / 2" if period % 2 == 0 else ""
    free = "close - trend" if additive else "close / trend"
    norm = "raw - avg(raw) OVER (PARTITION BY series_id)" if additive else "raw / avg(raw) OVER (PARTITION BY series_id)"
    rest = "close - trend - seasonal" if additive else "close / trend / seasonal"
    return f"""WITH {S.DAILY},
    a AS (SELECT *, CASE WHEN count(close) OVER {full} = {2 * half + 1} THEN (sum(close) OVER {full}{ends}) / {period} END AS trend,
      (pos - 1) % {period} AS phase FROM d),
    b AS (SELECT series_id, phase, avg({free}) AS raw FROM a GROUP BY 1, 2),
    e AS (SELECT series_id, phase, {norm} AS seasonal FROM b)
    SELECT a.*, seasonal, {rest} AS resid FROM a JOIN e ON e.series_id = a.series_id AND e.phase = a.phase"""


@query("seasonal_decompose", "series_id ts:t close:4 trend:4 seasonal:4 resid:4", _decompose_sql(7, True))
def seasonal_decompose(spark, sf_dir):
    return stats.seasonal_decompose(stage(T.daily(spark, sf_dir), "daily"), "close", 7)


@query("seasonal_decompose_yearly", "series_id ts:t close:4 trend:4 seasonal:4 resid:4", _decompose_sql(365, True))
def seasonal_decompose_yearly(spark, sf_dir):
    return stats.seasonal_decompose(stage(T.daily(spark, sf_dir), "daily"), "close", 365)


@query(
    "seasonal_decompose_monthly",
    "series_id ts:t close:4 trend:4 seasonal:6 resid:6",
    _decompose_sql(30, False),
)
def seasonal_decompose_monthly(spark, sf_dir):
    """Even period, multiplicative."""
    return stats.seasonal_decompose(stage(T.daily(spark, sf_dir), "daily"), "close", 30, "multiplicative")


@query("adf_test", "series_id stat:6 p_value:6 used_lag:i nobs:i crit_1:6 crit_5:6 crit_10:6")
def adf_test(spark, sf_dir):
    rows = stage(T.hourly(spark, sf_dir), "hourly")
    return tests.adf_test(rows, "close", tests.longest_default(rows))


_LEVEL = "CAST({} AS DOUBLE) + {} / CAST(m AS DOUBLE) + {} / pow(m, 2) + {} / pow(m, 3)"


@query(
    "adf_test_no_lags",
    "series_id stat:6 used_lag:i nobs:i crit_1:6 crit_5:6 crit_10:6",
    f"""WITH {S.HOURLY}, c AS (SELECT series_id, lag(close) OVER {S.W} AS x, close - lag(close) OVER {S.W} AS y FROM h),
    r AS (SELECT series_id, count(*) AS m, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS ssr
      FROM c WHERE x IS NOT NULL GROUP BY 1)
    SELECT series_id, b / sqrt(ssr / (m - 2) / sxx) AS stat, 0 AS used_lag, m AS nobs,
    {', '.join(f'{_LEVEL.format(*v)} AS {k}' for k, v in UNIT_ROOT_CRITICAL.items())} FROM r""",
)
def adf_test_no_lags(spark, sf_dir):
    return tests.adf_test(stage(T.hourly(spark, sf_dir), "hourly"), "close", 0)


# Two regressions on centred sums: the change on the level, and on the level and the change before.
_ADF_TWO = f"""{S.DAILY}, c0 AS (SELECT *, lag(close) OVER {S.W} AS x, close - lag(close) OVER {S.W} AS y FROM d),
  c AS (SELECT *, lag(y) OVER {S.W} AS w FROM c0),
  a AS (SELECT series_id, count(*) AS m, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM c WHERE x IS NOT NULL GROUP BY 1),
  b AS (SELECT series_id, count(*) AS m, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(w) AS ww, covar_pop(x, y) AS xy,
    covar_pop(x, w) AS xw, covar_pop(w, y) AS wy FROM c WHERE w IS NOT NULL GROUP BY 1),
  f AS (SELECT *, xx * ww - xw * xw AS det, (xy * ww - wy * xw) / (xx * ww - xw * xw) AS bx, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS bw FROM b),
  g AS (SELECT *, m * (yy - xy * xy / xx) AS s0, m * (yy - bx * xy - bw * wy) AS s1 FROM f),
  k AS (SELECT *, m * (ln(2 * pi() * s0 / m) + 1) + 4 AS aic0, m * (ln(2 * pi() * s1 / m) + 1) + 6 AS aic1 FROM g),
  r AS (SELECT k.series_id, CASE WHEN aic1 < aic0 THEN 1 ELSE 0 END AS used_lag, least(aic0, aic1) AS aic,
    CASE WHEN aic1 < aic0 THEN k.m ELSE a.m END AS m, CASE WHEN aic1 < aic0 THEN bx / sqrt(s1 / (k.m - 3) * ww / (k.m * det))
    ELSE a.xy / a.xx / sqrt((a.yy - a.xy * a.xy / a.xx) / (a.m - 2) / a.xx) END AS stat FROM k JOIN a ON a.series_id = k.series_id)"""


@query(
    "adf_test_two_lags",
    "series_id stat:6 used_lag:i nobs:i aic:3 crit_1:6 crit_5:6 crit_10:6",
    f"""WITH {_ADF_TWO} SELECT series_id, stat, used_lag, m AS nobs, aic,
    {', '.join(f'{_LEVEL.format(*v)} AS {k}' for k, v in UNIT_ROOT_CRITICAL.items())} FROM r""",
)
def adf_test_two_lags(spark, sf_dir):
    """No lagged change or one, whichever the criterion prefers."""
    return tests.adf_test(stage(T.daily(spark, sf_dir), "daily"), "close", 1)


@query(
    "ljung_box",
    "series_id lags:i stat:4 p_value:6",
    f"""WITH {PRED}, e AS (SELECT series_id, pos, "true" - pred AS x FROM p WHERE model = 'persistence'),
    {_acf_sql('e', 'x', 14)},
    q AS (SELECT series_id, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS stat FROM acf WHERE lag > 0 GROUP BY 1)
    SELECT series_id, 14 AS lags, stat, exp(-stat / 2) * (SELECT sum(pow(stat / 2, j) / gamma(j + 1)) FROM range(0, 7) AS t(j)) AS p_value
    FROM q""",
)
def ljung_box(spark, sf_dir):
    s = T.daily_split(spark, sf_dir)
    return stats.ljung_box(stage(metrics.residuals(forecasters.persistence(s, H, "test")), "residuals"), "residual", 14)


# Normal distribution function in SQL: density times the sum of x^(2j+1) / (1*3*...*(2j+1)), all of one sign.
_PHI = """(0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * j + 1) * ln(abs({x})) - (j + 1) * ln(2)
  - lgamma(j + 1.5) + ln(pi()) / 2)) FROM range(0, 200) AS t(j)))"""


def _dm_sql(norm: int) -> str:
    return f"""WITH {PRED},
    wide AS (SELECT series_id, pos, max("true") AS y, {', '.join(
        f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}" for m in BASES)} FROM p GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY series_id) AS n
      FROM wide WHERE {' AND '.join(f'{m} IS NOT NULL' for m in BASES)}),
    pr AS ({' UNION ALL '.join(
        f"SELECT series_id, i, n, '{a}' AS model_a, '{b}' AS model_b, pow(abs(y - {a}), {norm}) AS la, pow(abs(y - {b}), {norm}) AS lb FROM k"
        for i, a in enumerate(BASES) for b in BASES[i + 1:])}),
    fo AS (SELECT series_id, model_a, model_b, (i - n % 2 - 1) // 2 AS fold, avg(la - lb) AS dif, sum(la) AS la, sum(lb) AS lb
      FROM pr WHERE i > n % 2 GROUP BY 1, 2, 3, 4),
    st AS (SELECT series_id, model_a, model_b, count(*) * 2 AS rows, sum(la) / (count(*) * 2) AS loss_a,
      sum(lb) / (count(*) * 2) AS loss_b, avg(dif) / sqrt(var_pop(dif) / count(*)) AS stat FROM fo GROUP BY 1, 2, 3)
    SELECT *, {_PHI.format(x='stat')} AS p_b_worse, 1 - {_PHI.format(x='stat')} AS p_a_worse FROM st"""


_DM = "series_id model_a model_b rows:i loss_a:2 loss_b:2 stat:6 p_a_worse:6 p_b_worse:6"


@query("dm_test", _DM.replace("loss_a:2 loss_b:2 ", ""), _dm_sql(2))
def dm_test(spark, sf_dir):
    return tests.dm_test(test_predictions(spark, sf_dir), BASES, norm=2)


@query("dm_test_all_pairs", _DM, _dm_sql(1))
def dm_test_all_pairs(spark, sf_dir):
    return tests.dm_test(test_predictions(spark, sf_dir), BASES, norm=1)


@query(
    "dm_verdict",
    "series_id model_a model_b better",
    f"""SELECT *, CASE WHEN p_a_worse < 0.05 THEN model_b WHEN p_b_worse < 0.05 THEN model_a END AS better FROM ({_dm_sql(1)}) AS t""",
)
def dm_verdict(spark, sf_dir):
    """The better model of each pair where the test decides."""
    return tests.dm_verdict(tests.dm_test(test_predictions(spark, sf_dir), BASES, norm=1))


@query("residuals", "series_id model ts:t residual:4", f'WITH {PRED} SELECT *, "true" - pred AS residual FROM p')
def residuals(spark, sf_dir):
    return metrics.residuals(test_predictions(spark, sf_dir))


@query("mape", "series_id model mape:6", f"WITH {PRED} SELECT series_id, model, {S.mape_sql()} AS mape FROM p GROUP BY 1, 2")
def mape(spark, sf_dir):
    return metrics.mape(test_predictions(spark, sf_dir))


@query(
    "da_diff",
    "series_id model da:6",
    f"""WITH {PRED}, x AS (SELECT *, "true" - lag("true", {H}) OVER w AS dt, pred - lag(pred, {H}) OVER w AS dp FROM p
    WHERE model = 'mean_7' WINDOW w AS (PARTITION BY series_id ORDER BY pos))
    SELECT series_id, model, coalesce(avg(CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END)
    FILTER (dt IS NOT NULL AND dp IS NOT NULL) * 100, 50) AS da FROM x GROUP BY 1, 2""",
)
def da_diff(spark, sf_dir):
    s = T.daily_split(spark, sf_dir)
    return metrics.da_by_change(stage(forecasters.trailing_mean(s, H, 7, "test"), "predictions"), H)


@query(
    "da_baseline",
    "series_id model da:6",
    f"""WITH {PRED}, x AS (SELECT p.*, s.close AS b FROM p JOIN s ON s.series_id = p.series_id AND s.pos = p.pos - {H})
    SELECT series_id, model, avg(CASE WHEN sign("true" - b) = sign(pred - b) THEN 1.0 ELSE 0.0 END) * 100 AS da
    FROM x GROUP BY 1, 2""",
)
def da_baseline(spark, sf_dir):
    return metrics.da_by_baseline(test_predictions(spark, sf_dir), T.daily(spark, sf_dir), H)


_RET = f"""{PRED}, x AS (SELECT p.*, ln(p."true" / s.close) AS true_return, ln(p.pred / p.base) AS pred_return FROM p
  JOIN s ON s.series_id = p.series_id AND s.pos = p.pos - 1)"""


@query(
    "da_return_sign",
    "series_id model da:6",
    f"""WITH {_RET} SELECT series_id, model, avg(CASE WHEN sign(pred_return) = sign(true_return) THEN 1.0 ELSE 0.0 END) * 100
    AS da FROM x GROUP BY 1, 2""",
)
def da_return_sign(spark, sf_dir):
    """True one-day return against the return that the prediction implies."""
    previous = T.daily(spark, sf_dir).select(KEY, (F.col(POS) + 1).alias(POS), F.col("close").alias("_day_before"))
    returns = test_predictions(spark, sf_dir).join(previous, [KEY, POS])
    return metrics.da_by_return_sign(
        returns.withColumns(
            {"true_return": F.log(F.col("true") / F.col("_day_before")), "pred_return": F.log(F.col("pred") / F.col("base"))}
        )
    )


def _points_sql(source: str, x: str) -> str:
    return f"""SELECT *, mean + sd * theoretical AS line FROM (SELECT series_id, rank, sample, mean, sd, {S.normal_quantile('u')} AS theoretical
      FROM (SELECT *, rank / (n + CAST(1 AS DOUBLE)) AS u FROM (SELECT series_id, {x} AS sample, row_number() OVER (PARTITION BY series_id ORDER BY {x}) AS rank,
        count({x}) OVER o AS n, avg({x}) OVER o AS mean, stddev_pop({x}) OVER o AS sd FROM {source} WHERE {x} IS NOT NULL
        WINDOW o AS (PARTITION BY series_id)) AS a) AS b) AS q"""


@query("qq_points", "series_id rank:i theoretical:6 sample:4 line:4", f"WITH {S.HOURLY} {_points_sql('h', 'close')}")
def qq_points(spark, sf_dir):
    return stats.normal_quantile_points(stage(T.hourly(spark, sf_dir), "hourly"), "close")


@query(
    "value_ranks",
    "series_id rank:i value:4",
    f"WITH {S.HOURLY} SELECT series_id, close AS value, row_number() OVER (PARTITION BY series_id ORDER BY close) AS rank FROM h",
)
def value_ranks(spark, sf_dir):
    """The ranks behind the quantile points."""
    return stats.rank_by_value(stage(T.hourly(spark, sf_dir), "hourly"), "close")


_PANEL = f"""WITH RECURSIVE {PRED}, e AS (SELECT series_id, pos, "true" - pred AS residual FROM p WHERE model = 'persistence'),
{_acf_sql('e', 'residual', 14)}, {_pacf_sql(14)},
hist AS ({_histogram_sql('e', 'residual', 30)}), points AS ({_points_sql('e', 'residual')}),
span AS (SELECT series_id, min(residual) AS mn, max(residual) AS mx, count(*) AS m, stddev_samp(residual) * pow(count(*), -0.2) AS bw FROM e GROUP BY 1),
place AS (SELECT span.*, mn - (mx - mn) * 0.5 + i * ((mx - mn) * 2 / 999) AS x FROM span, range(0, 1000) AS g(i))
SELECT series_id, 'series' AS panel, CAST(pos AS DOUBLE) AS x, residual AS y FROM e
UNION ALL SELECT series_id, 'histogram', "left", density FROM hist UNION ALL SELECT series_id, 'acf', lag, acf FROM acf
UNION ALL SELECT series_id, 'pacf', lag, pacf FROM pacf UNION ALL SELECT series_id, 'quantiles', theoretical, sample FROM points
UNION ALL SELECT place.series_id, 'density', x, sum(exp(-pow((x - residual) / bw, 2) / 2)) / (any_value(m) * any_value(bw) * sqrt(2 * pi()))
  FROM place JOIN e ON e.series_id = place.series_id GROUP BY place.series_id, x"""


@query("residual_panel", "series_id panel x:6 y:6", _PANEL)
def panel(spark, sf_dir):
    """All tables of the panel in long form."""
    s = T.daily_split(spark, sf_dir)
    parts = residual_panel(stage(forecasters.persistence(s, H, "test"), "predictions"), 14)
    axes = {
        "series": (POS, "residual"), "histogram": ("left", "density"), "density": ("x", "density"),
        "acf": ("lag", "acf"), "pacf": ("lag", "pacf"), "quantiles": ("theoretical", "sample"),
    }
    long = [
        parts[name].select(KEY, F.lit(name).alias("panel"), F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
        for name, (x, y) in axes.items()
    ]
    return union_splits(*long)
