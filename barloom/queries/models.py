"""Forecasters, stacks, searches and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.operators import autoregression as ar
from barloom.operators import datasets, forecasters, joins, metrics
from barloom.operators.tests_of_series import dm_test
from barloom.plans import tables as T
from barloom.plans.blocks import KEY, over_blocks, trailing
from barloom.plans.flows import evaluate_all, evaluate_models
from barloom.plans.staging import stage
from barloom.queries import sqlparts as S
from barloom.queries.statistics import H, PRED, test_predictions
from barloom.queries.tables import EXTERNAL_SQL, SCALED_ROWS, STEPS, WINDOW, both_matrices, external_predictions, matrix, staged_features

_METRICS = f"""{PRED}, k AS (SELECT series_id, model, {S.mape_sql()} AS mape,
  avg(CASE WHEN sign("true" - base) = sign(pred - base) THEN 1.0 ELSE 0.0 END) * 100 AS da, count(*) AS rows
  FROM p GROUP BY 1, 2)"""
_SCORE = "series_id model mape:6 da:6 rows:i"
_SIGNAL = """CASE WHEN {b} = 0 THEN sign({v} - {b}) WHEN ({v} - {b}) / {b} > 0.005 THEN 1.0
  WHEN ({v} - {b}) / {b} < -0.005 THEN -1.0 ELSE 0.0 END"""

TRIALS = 15
RUNGS = (1, 3, 9)  # trees that trials of the search grow before and after they are pruned


@query(
    "naive_backtest",
    "series_id model mape:6 da:6",
    f"""WITH {PRED}, n AS (SELECT *, "true" - lag("true", {H}) OVER w AS dt, pred - lag(pred, {H}) OVER w AS dp
    FROM p WHERE model = 'persistence' WINDOW w AS (PARTITION BY series_id ORDER BY pos))
    SELECT series_id, model, {S.mape_sql()} AS mape, avg(CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END)
    FILTER (dt IS NOT NULL AND dp IS NOT NULL) * 100 AS da FROM n GROUP BY 1, 2""",
)
def naive_backtest(spark, sf_dir):
    preds = stage(forecasters.persistence(T.daily_split(spark, sf_dir), H, "test"), "predictions")
    return metrics.mape(preds).join(metrics.da_by_change(preds, H), [KEY, "model"])


@query(
    "naive_forecast",
    "series_id ts_future pred:4 sig:1",
    f"""WITH {S.HOURLY}, x AS (SELECT series_id, max(ts) AS ts, arg_max(close, pos) AS v, arg_max(prev, pos) AS b
    FROM (SELECT *, lag(close) OVER {S.W} AS prev FROM h) AS y GROUP BY 1)
    SELECT series_id, strftime(ts + INTERVAL {H} HOUR, '%Y-%m-%d') AS ts_future, v AS pred, {_SIGNAL.format(v='v', b='b')} AS sig FROM x""",
)
def naive_forecast(spark, sf_dir):
    """The frequency is that of the series."""
    return forecasters.naive_forecast(stage(T.hourly(spark, sf_dir), "hourly"), H)


@query("backtest_metrics", _SCORE, f"WITH {_METRICS} SELECT * FROM k")
def backtest_metrics(spark, sf_dir):
    return metrics.score(test_predictions(spark, sf_dir))


@query(
    "select_best_model",
    "series_id model mape:6 da:6",
    f"""WITH {_METRICS} SELECT k.* FROM k JOIN k AS b ON b.series_id = k.series_id AND b.model = 'persistence'
    WHERE k.model <> 'persistence' AND k.mape < b.mape AND k.da > b.da
    QUALIFY row_number() OVER (PARTITION BY k.series_id ORDER BY k.da DESC, k.mape) = 1""",
)
def select_best_model(spark, sf_dir):
    return metrics.select_best(metrics.score(test_predictions(spark, sf_dir)), "persistence")


@query("leaderboard", _SCORE, f"WITH {_METRICS} SELECT * FROM k ORDER BY da DESC, mape")
def leaderboard(spark, sf_dir):
    return metrics.leaderboard(metrics.score(test_predictions(spark, sf_dir)))


@query(
    "score_external_predictions",
    "series_id model mape:6 da:6 da_return:6 rows:i",
    f"""WITH {EXTERNAL_SQL} SELECT series_id, 'external' AS model, {S.mape_sql()} AS mape,
    avg(CASE WHEN sign("true" - base) = sign(pred - base) THEN 1.0 ELSE 0.0 END) * 100 AS da,
    avg(CASE WHEN sign(pred_return) = sign(true_return) THEN 1.0 ELSE 0.0 END) * 100 AS da_return, count(*) AS rows
    FROM y GROUP BY 1""",
)
def score_external_predictions(spark, sf_dir):
    preds = stage(external_predictions(spark, sf_dir), "external")
    by_return = metrics.da_by_return_sign(preds).withColumnRenamed("da", "da_return")
    return metrics.score(preds).join(by_return, [KEY, "model"])


# ------------------------------------------------------------ autoregression


@query("ar_backtest", _SCORE)
def ar_backtest(spark, sf_dir):
    s = T.daily_split(spark, sf_dir)
    return metrics.score(ar.ar_backtest(s, (5, 1, 3), 60, H))


@query("ar_forecast", "series_id ts_future pred:4 sig:1")
def ar_forecast(spark, sf_dir):
    return ar.ar_forecast(T.daily_split(spark, sf_dir), (5, 1, 3), H, "D")


@query("ar_order_search", "series_id model p:i d:i q:i mape:6 da:6")
def ar_order_search(spark, sf_dir):
    """All 49 orders on the validation rows."""
    return ar.order_search(T.daily_split(spark, sf_dir), [(p, 1, q) for p in range(7) for q in range(7)], 60, H)


def _one_lag(fit: str) -> str:
    """Log differences ``y`` of the daily bars, and the least squares coefficient of ``y`` on its predecessor."""
    return f"""{S.DAILY_SPLIT}, l AS (SELECT *, ln(close) AS x, ln(close) - lag(ln(close)) OVER {S.W} AS y FROM s),
    k AS (SELECT series_id, sum(a * b) / sum(b * b) AS phi FROM (SELECT series_id, CASE WHEN split IN ({fit}) THEN y END AS a,
      lag(CASE WHEN split IN ({fit}) THEN y END) OVER {S.W} AS b FROM l) AS z WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)"""


def _ahead(steps: int) -> str:
    return "(" + " + ".join(f"pow(phi, {k})" for k in range(1, steps + 1)) + ")"


def _one_lag_steps(split: str, fit: str) -> str:
    """Predictions of orders (1,1,0) and (0,1,0), whose history ends one row before the base row."""
    return f"""{_one_lag(fit)}, w AS (SELECT l.series_id, split, phi, lag(split, {H}) OVER v AS from_split, pos, close AS "true",
      lag(close, {H}) OVER v AS base, lag(x, {H + 1}) OVER v AS x, lag(y, {H + 1}) OVER v AS y
      FROM l JOIN k ON k.series_id = l.series_id WINDOW v AS (PARTITION BY l.series_id ORDER BY pos)),
    p AS (SELECT series_id, pos, "true", base, 'ar(1,1,0)' AS model, 1 AS p, exp(x + y * {_ahead(H + 1)}) AS pred FROM w
        WHERE split = '{split}' AND from_split = '{split}' AND pos > 60 + {H}
      UNION ALL SELECT series_id, pos, "true", base, 'ar(0,1,0)', 0, exp(x) FROM w
        WHERE split = '{split}' AND from_split = '{split}' AND pos > 60 + {H})"""


_HITS = 'avg(CASE WHEN sign("true" - base) = sign(pred - base) THEN 1.0 ELSE 0.0 END) * 100 AS da'


@query(
    "ar_backtest_one_lag",
    _SCORE,
    f"""WITH {_one_lag_steps('test', "'train', 'valid'")} SELECT series_id, model, {S.mape_sql()} AS mape, {_HITS}, count(*) AS rows
    FROM p WHERE p = 1 GROUP BY 1, 2""",
)
def ar_backtest_one_lag(spark, sf_dir):
    """The order that has a closed form, fitted on train and valid."""
    return metrics.score(ar.ar_backtest(T.daily_split(spark, sf_dir), (1, 1, 0), 60, H))


@query(
    "ar_forecast_one_lag",
    "series_id ts_future pred:4 sig:1",
    f"""WITH {_one_lag("'train', 'valid', 'test'")}, e AS (SELECT series_id, max(ts) AS ts, arg_max(x, pos) AS x, arg_max(y, pos) AS y,
      arg_max(close, pos) AS v FROM l GROUP BY 1),
    o AS (SELECT e.*, exp(x + y * {_ahead(H)}) AS pred FROM e JOIN k ON k.series_id = e.series_id)
    SELECT series_id, strftime(ts + INTERVAL {H} DAY, '%Y-%m-%d') AS ts_future, pred, {_SIGNAL.format(v='pred', b='v')} AS sig FROM o""",
)
def ar_forecast_one_lag(spark, sf_dir):
    return ar.ar_forecast(T.daily_split(spark, sf_dir), (1, 1, 0), H, "D")


@query(
    "ar_order_search_two",
    "series_id model p:i d:i q:i mape:6 da:6",
    f"""WITH {_one_lag_steps('valid', "'train'")} SELECT series_id, model, p, 1 AS d, 0 AS q, {S.mape_sql()} AS mape, {_HITS}
    FROM p GROUP BY 1, 2, 3""",
)
def ar_order_search_two(spark, sf_dir):
    return ar.order_search(T.daily_split(spark, sf_dir), [(0, 1, 0), (1, 1, 0)], 60, H)


# ------------------------------------------------------------ direct learners


def _lag_table(m, fit_splits=datasets.FIRST_FIT, horizons=(H,), window=WINDOW):
    return stage(datasets.lag_feature_table(m, window, list(horizons), fit_splits=fit_splits), "lag-table")


def _scored(preds):
    preds = stage(preds, "predictions")
    by_return = metrics.da_by_return_sign(preds).withColumnRenamed("da", "da_return")
    return metrics.score(preds).join(by_return, [KEY, "model"])


@query("gbt_direct_fit", "horizon:i rows:i trees:i mae_train:6 mae_valid:6")
def gbt_direct_fit(spark, sf_dir):
    """One model for each of the horizons 1..H, its number of trees chosen on the validation rows."""
    table = _lag_table(matrix(spark, sf_dir), horizons=range(1, H + 1))
    fitted = forecasters.fit_horizons(table, forecasters.validated_trees(), list(range(1, H + 1)))
    rows = table.withColumn("vector", forecasters.array_to_vector("features")).where("split <> 'test'")
    parts = []
    for h, model in fitted.items():
        error = F.abs(F.col("scaled") - F.col(f"label_{h}"))
        scored = model.transform(rows.where(F.col(f"label_{h}").isNotNull()))
        parts.append(
            scored.agg(
                F.lit(h).alias("horizon"), F.count(F.lit(1)).alias("rows"), F.lit(model.getNumTrees).alias("trees"),
                *[F.avg(F.when(F.col("split") == s, error)).alias(f"mae_{s}") for s in ("train", "valid")],
            )
        )
    return joins.union_splits(*parts)


def _boosted(spark, sf_dir):
    """Matrices, lag tables and fits of both stages: on train with trees chosen on valid, then on both splits."""
    m = both_matrices(spark, sf_dir)
    tables = {fit: _lag_table(m[fit], fit) for fit in m}
    learner = forecasters.validated_trees()
    first = forecasters.fit_validated(tables[datasets.FIRST_FIT], learner, H)
    return m, tables, first, forecasters.refit(first, tables[datasets.REFIT], learner, H)


@query("gbt_backtest", "series_id model mape:6 da:6 da_return:6 rows:i")
def gbt_backtest(spark, sf_dir):
    """Scores on valid of the first fit and on test of the fit on train and valid."""
    m, _, first, again = _boosted(spark, sf_dir)
    stages = ((first, datasets.FIRST_FIT, "valid"), (again, datasets.REFIT, "test"))
    return _scored(
        joins.union_splits(
            *[forecasters.apply_direct(model, datasets.walk_forward_frames(m[fit], WINDOW, H, split), f"gbt_{split}") for model, fit, split in stages]
        )
    )


@query("gbt_forecast", "series_id ts_future pred:4 sig:1")
def gbt_forecast(spark, sf_dir):
    """From the fit on train and valid."""
    m, tables, _, again = _boosted(spark, sf_dir)
    return forecasters.direct_forecast(again, tables[datasets.REFIT], m[datasets.REFIT], H, "D")


@query("linear_direct_backtest", "series_id model mape:6 da:6 da_return:6 rows:i")
def linear_direct_backtest(spark, sf_dir):
    m = matrix(spark, sf_dir)
    fitted = forecasters.fit_direct(_lag_table(m), forecasters.linear_learner(), H)
    return _scored(forecasters.apply_direct(fitted, datasets.walk_forward_frames(m, WINDOW, H, "valid"), "linear"))


# Learners whose fit SQL can compute: a line through one column, and one tree of one split on columns of 0 and 1.
_ONE_ROW = f"""{SCALED_ROWS}, lab AS (SELECT *, lead(z, {H}) OVER {S.W} AS label, lead(split, {H}) OVER {S.W} AS to_split,
  lead(ts, {H}) OVER {S.W} AS ts_to, lead(close, {H}) OVER {S.W} AS "true", lead(target, {H}) OVER {S.W} AS true_return FROM zr),
tr AS (SELECT * FROM lab WHERE split = 'train' AND to_split = 'train')"""
_RETURNS_SCORED = f"""SELECT series_id, model, {S.mape_sql()} AS mape, {_HITS},
  avg(CASE WHEN sign(pred_return) = sign(true_return) THEN 1.0 ELSE 0.0 END) * 100 AS da_return, count(*) AS rows FROM p GROUP BY 1, 2"""


def _steps(scaled: str, fit: str, split: str, model: str) -> str:
    return f"""p AS (SELECT series_id, '{model}' AS model, "true", close AS base, true_return, ({scaled}) * std + mean AS pred_return,
      close * exp(({scaled}) * std + mean) AS pred FROM lab, {fit} WHERE split = '{split}' AND to_split = '{split}')"""


_LINE = f"{_ONE_ROW}, ln AS (SELECT regr_slope(label, z) AS slope, regr_intercept(label, z) AS start FROM tr)"
_STUMP = f"""{_ONE_ROW}, sp AS (SELECT name, avg(label) FILTER (hot = 1) AS one, avg(label) FILTER (hot = 0) AS zero,
    var_pop(label) - (coalesce(var_pop(label) FILTER (hot = 1) * count(*) FILTER (hot = 1), 0)
    + coalesce(var_pop(label) FILTER (hot = 0) * count(*) FILTER (hot = 0), 0)) / count(*) AS gain
  FROM (SELECT label, unnest([{', '.join(f"'{c}'" for c in STEPS)}]) AS name, unnest([{', '.join(f'up_{c}' for c in STEPS)}]) AS hot FROM tr)
  GROUP BY name), st AS (SELECT * FROM sp WHERE one IS NOT NULL AND zero IS NOT NULL ORDER BY gain DESC LIMIT 1)"""
_STUMP_VALUE = f"CASE CASE name {' '.join(f"WHEN '{c}' THEN up_{c}" for c in STEPS)} END WHEN 1 THEN one ELSE zero END"


def _one_row(spark, sf_dir, inputs, learner):
    """Fit on a few values of the last row alone; ``inputs`` makes them from the scaled columns by name."""
    scaled = {c: F.col("x")[S.NUMERIC.index(c)] for c in STEPS}
    m = stage(matrix(spark, sf_dir).withColumn("x", F.array(*inputs(scaled))), "one-row")
    table = _lag_table(m, window=1)
    return m, table, forecasters.fit_direct(table, learner, H)


def _line(spark, sf_dir):
    return _one_row(spark, sf_dir, lambda z: [z["log_returns_close"]], forecasters.linear_learner(regParam=0.0))


def _stump(spark, sf_dir):
    ups = lambda z: [F.when(v > 0, 1.0).otherwise(0.0) for v in z.values()]
    return _one_row(spark, sf_dir, ups, forecasters.boosted_trees(maxIter=1, maxDepth=1))


@query("linear_direct_backtest_one_column", "series_id model mape:6 da:6 da_return:6 rows:i", f"WITH {_LINE}, {_steps('start + slope * z', 'ln', 'valid', 'line')} {_RETURNS_SCORED}")
def linear_direct_backtest_one_column(spark, sf_dir):
    m, _, fitted = _line(spark, sf_dir)
    return _scored(forecasters.apply_direct(fitted, datasets.walk_forward_frames(m, 1, H, "valid"), "line"))


@query("gbt_backtest_one_split", "series_id model mape:6 da:6 da_return:6 rows:i", f"WITH {_STUMP}, {_steps(_STUMP_VALUE, 'st', 'valid', 'stump')} {_RETURNS_SCORED}")
def gbt_backtest_one_split(spark, sf_dir):
    m, _, fitted = _stump(spark, sf_dir)
    return _scored(forecasters.apply_direct(fitted, datasets.walk_forward_frames(m, 1, H, "valid"), "stump"))


@query(
    "gbt_direct_fit_one_split",
    "rows:i mae:6",
    f"WITH {_STUMP} SELECT count(*) AS rows, avg(abs(label - {_STUMP_VALUE})) AS mae FROM tr, st",
)
def gbt_direct_fit_one_split(spark, sf_dir):
    _, table, fitted = _stump(spark, sf_dir)
    rows = table.where((F.col("split") == "train") & F.col(f"label_{H}").isNotNull())
    scored = fitted.transform(rows.withColumn("vector", forecasters.array_to_vector("features")))
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("scaled") - F.col(f"label_{H}"))).alias("mae"))


@query(
    "gbt_forecast_one_split",
    "series_id ts_future pred:4 sig:1",
    f"""WITH {_STUMP}, o AS (SELECT series_id, ts, close AS v, close * exp(({_STUMP_VALUE}) * std + mean) AS pred FROM lab, st
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) = 1)
    SELECT series_id, strftime(ts + INTERVAL {H} DAY, '%Y-%m-%d') AS ts_future, pred, {_SIGNAL.format(v='pred', b='v')} AS sig FROM o""",
)
def gbt_forecast_one_split(spark, sf_dir):
    m, table, fitted = _stump(spark, sf_dir)
    return forecasters.direct_forecast(fitted, table, m, H, "D")


@query(
    "grid_search_lines",
    "trial mae:6 rows:i",
    f"""WITH {_ONE_ROW}, g AS (SELECT regr_slope(label, z) AS slope, regr_intercept(label, z) AS start, avg(label) AS middle FROM tr),
    va AS (SELECT * FROM lab WHERE split = 'valid' AND to_split = 'valid')
    SELECT 'line' AS trial, avg(abs(label - start - slope * z)) AS mae, count(*) AS rows FROM va, g
    UNION ALL SELECT 'mean', avg(abs(label - middle)), count(*) FROM va, g""",
)
def grid_search_lines(spark, sf_dir):
    """Two trials that SQL can fit: a line, and one so heavily shrunk that the mean is left."""
    _, table, _ = _line(spark, sf_dir)
    trials = {"line": forecasters.linear_learner(regParam=0.0), "mean": forecasters.linear_learner(regParam=1e12)}
    return forecasters.grid_search(table, trials, H)


@query("grid_search_direct", "trial rounds:i mae:6 rows:i pruned")
def grid_search_direct(spark, sf_dir):
    """A search over random trees, trials above the median given up at each rung."""
    table = _lag_table(matrix(spark, sf_dir))
    return forecasters.pruned_search(table, forecasters.random_trees(TRIALS), H, RUNGS)


# --------------------------------------------------------------------- stacks

STACK = ["mean_7", "mean_30"]
# Closed form of least squares on two columns.
_STACK = f"""{S.DAILY_SPLIT}, {S.predictions(H, 'valid', name='pv')}, {S.predictions(H, 'test', name='pt')},
wv AS (SELECT series_id, pos, max("true") AS y, max(CASE WHEN model = 'mean_7' THEN pred END) AS a,
  max(CASE WHEN model = 'mean_30' THEN pred END) AS b FROM pv GROUP BY 1, 2),
mv AS (SELECT series_id, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb,
  avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS m FROM wv WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
co AS (SELECT series_id, m, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb, my, ma, mb FROM mv),
cf AS (SELECT *, my - ca * ma - cb * mb AS c0 FROM co),
wt AS (SELECT series_id, pos, ts, max("true") AS y, max(base) AS base, max(CASE WHEN model = 'mean_7' THEN pred END) AS a,
  max(CASE WHEN model = 'mean_30' THEN pred END) AS b FROM pt GROUP BY 1, 2, 3),
st AS (SELECT wt.series_id, 'stack' AS model, ts, y AS "true", c0 + ca * a + cb * b AS pred, base FROM wt
  JOIN cf ON cf.series_id = wt.series_id WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _base_predictions(s, split):
    return joins.union_splits(*[forecasters.trailing_mean(s, H, n, split) for n in (7, 30)])


def _meta(s):
    return forecasters.stack_fit(_base_predictions(s, "valid"), STACK)


@query("stack_fit", "series_id intercept:2 mean_7:5 mean_30:5 m:i", f"WITH {_STACK} SELECT series_id, c0 AS intercept, ca AS mean_7, cb AS mean_30, m FROM cf")
def stack_fit(spark, sf_dir):
    c = F.col("coefficients")
    return _meta(T.daily_split(spark, sf_dir)).select(
        KEY, c[0].alias("intercept"), c[1].alias("mean_7"), c[2].alias("mean_30"), "m"
    )


@query(
    "stack_backtest",
    "series_id model mape:5 da:5 rows:i",
    f"""WITH {_STACK} SELECT series_id, model, {S.mape_sql()} AS mape,
    avg(CASE WHEN sign("true" - base) = sign(pred - base) THEN 1.0 ELSE 0.0 END) * 100 AS da, count(*) AS rows FROM st GROUP BY 1, 2""",
)
def stack_backtest(spark, sf_dir):
    s = T.daily_split(spark, sf_dir)
    return metrics.score(forecasters.stack_predictions(_base_predictions(s, "test"), _meta(s), STACK))


@query(
    "stack_forecast",
    "series_id ts_future pred:2 sig:1",
    f"""WITH {_STACK}, l AS (SELECT series_id, pos, ts, close, {S.roll('avg', 'close', 7)} AS a, {S.roll('avg', 'close', 30)} AS b FROM s),
    e AS (SELECT series_id, max(ts) AS ts, arg_max(close, pos) AS v, arg_max(a, pos) AS a, arg_max(b, pos) AS b FROM l GROUP BY 1),
    o AS (SELECT e.*, c0 + ca * e.a + cb * e.b AS pred FROM e JOIN cf ON cf.series_id = e.series_id)
    SELECT series_id, strftime(ts + INTERVAL {H} DAY, '%Y-%m-%d') AS ts_future, pred, {_SIGNAL.format(v='pred', b='v')} AS sig FROM o""",
)
def stack_forecast(spark, sf_dir):
    s = T.daily_split(spark, sf_dir)

    def add(t):
        return t.withColumns({f"mean_{n}": F.avg("close").over(trailing(n)) for n in (7, 30)})

    means = over_blocks(s.select(KEY, "ts", "pos", "close"), add, behind=29)
    finals = means.groupBy(KEY).agg(*[F.max_by(c, "pos").alias(c) for c in STACK])
    return forecasters.stack_forecast(finals, _meta(s), STACK, s, H, "D")


# ----------------------------------------------------------------- evaluation


def _evaluation(spark, sf_dir):
    learners = {"linear": forecasters.linear_learner(), "trees": forecasters.validated_trees()}
    return evaluate_models(T.daily_split(spark, sf_dir), staged_features(spark, sf_dir), S.NUMERIC, H, WINDOW, learners=learners)


@query("evaluate_all_models", "series_id model mape:6 da:6 rows:i")
def evaluate_all_models(spark, sf_dir):
    return metrics.leaderboard(metrics.score(_evaluation(spark, sf_dir).predictions))


@query("evaluate_all_forecasts", "series_id model ts_future pred:4 sig:1")
def evaluate_all_forecasts(spark, sf_dir):
    """Forecasts past the end of each series from every model."""
    return _evaluation(spark, sf_dir).forecasts


@query("evaluate_all_pairs", "series_id model_a model_b rows:i loss_a:4 loss_b:4 stat:6 p_a_worse:6 p_b_worse:6")
def evaluate_all_pairs(spark, sf_dir):
    """Pairwise tests over persistence, autoregression, a linear learner and its stack."""
    f = staged_features(spark, sf_dir)
    preds = evaluate_all(T.daily_split(spark, sf_dir), f, S.NUMERIC, H, WINDOW)
    return dm_test(preds, ["persistence", "ar(5,1,3)", "linear", "stack_linear"], norm=1)


