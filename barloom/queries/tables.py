"""Joins, feature table and learning data."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import query
from barloom.functions import columns as C
from barloom.operators import datasets, features, forecasters, joins
from barloom.plans import tables as T
from barloom.plans.blocks import KEY, POS, TS
from barloom.plans.staging import stage
from barloom.queries import sqlparts as S
from barloom.queries.statistics import BASES, H, PRED, test_predictions

WINDOW = 7


def feature_rows(spark, sf_dir):
    macro = joins.macro_table(T.monthly_rate(spark, sf_dir), T.monthly_supply(spark, sf_dir))
    return features.feature_table(T.daily_split(spark, sf_dir), stage(macro, "macro"))


def staged_features(spark, sf_dir):
    return stage(feature_rows(spark, sf_dir), "features")


def matrix(spark, sf_dir):
    return stage(datasets.model_matrix(staged_features(spark, sf_dir), S.NUMERIC, "log_returns_close"), "matrix")


def both_matrices(spark, sf_dir):
    """Learning data scaled by train, and by train and valid together for the fit before the test."""
    rows = staged_features(spark, sf_dir)
    return {
        fit: stage(datasets.model_matrix(rows, S.NUMERIC, "log_returns_close", fit_splits=fit), "matrix")
        for fit in (datasets.FIRST_FIT, datasets.REFIT)
    }


@query("macro_inner_join", "month:d fed_rate:6 m2_supply:2", f"WITH {S.MACRO} SELECT * FROM months")
def macro_inner_join(spark, sf_dir):
    return joins.join_months(T.monthly_rate(spark, sf_dir), T.monthly_supply(spark, sf_dir))


@query(
    "macro_month_join",
    "series_id ts:t close:4 fed_rate:6 m2_supply_mom_pct:6",
    f"""WITH {S.DAILY}, {S.MACRO}, x AS (SELECT d.*, fed_rate, m2_supply_mom_pct FROM d
    LEFT JOIN macro ON macro.month = CAST(date_trunc('month', ts) AS DATE))
    SELECT series_id, ts, close, coalesce({S.ffill('fed_rate')}, 0) AS fed_rate,
    coalesce({S.ffill('m2_supply_mom_pct')}, 0) AS m2_supply_mom_pct FROM x""",
)
def macro_month_join(spark, sf_dir):
    macro = joins.macro_table(T.monthly_rate(spark, sf_dir), T.monthly_supply(spark, sf_dir))
    return joins.add_macro(T.daily(spark, sf_dir), stage(macro, "macro"))


@query(
    "union_splits",
    "series_id ts:t split close:4 note",
    f"WITH {S.DAILY_SPLIT} SELECT *, CASE WHEN split = 'test' THEN 'unseen' END AS note FROM s",
)
def union_splits(spark, sf_dir):
    """The three parts together again; only the last has the extra column."""
    s = T.daily_split(spark, sf_dir)
    parts = {name: s.where(F.col("split") == name) for name in ("train", "valid", "test")}
    return joins.union_splits(parts["train"], parts["valid"], parts["test"].withColumn("note", F.lit("unseen")))


_WIDE = ", ".join(f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}" for m in BASES)


@query(
    "align_predictions",
    "series_id ts:t true:4 persistence:4 mean_7:4 mean_30:4",
    f"""WITH {PRED}, x AS (SELECT series_id, ts, max("true") AS "true", {_WIDE} FROM p GROUP BY 1, 2)
    SELECT * FROM x WHERE {' AND '.join(f'{m} IS NOT NULL' for m in BASES)}""",
)
def align_predictions(spark, sf_dir):
    return joins.align_predictions(test_predictions(spark, sf_dir), BASES)


@query(
    "baseline_attach",
    "series_id model ts:t true:4 pred:4 baseline:4",
    f"""WITH {PRED} SELECT p.*, s.close AS baseline FROM p JOIN s ON s.series_id = p.series_id AND s.pos = p.pos - {H}""",
)
def baseline_attach(spark, sf_dir):
    return joins.attach_baseline(test_predictions(spark, sf_dir), T.daily(spark, sf_dir), H)


@query(
    "order_grid",
    "series_id p:i d:i q:i rows:i",
    f"""WITH {S.HOURLY}, n AS (SELECT series_id, count(*) AS rows FROM h GROUP BY 1)
    SELECT series_id, p, 1 AS d, q, rows FROM n, range(0, 7) AS a(p), range(0, 7) AS b(q)""",
)
def order_grid(spark, sf_dir):
    """Every order for every series: the work list of an order search."""
    sizes = T.event_bars(spark, sf_dir, "h").groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    return joins.orders_of(sizes, list(range(7)), [1], list(range(7)))


_INDICATORS = "series_id ts:t sma_50:4 rsi_14:6 atr_14:4 obv:4 macd_12_26_9:3 macd_signal_12_26_9:3 macd_hist_12_26_9:3 price_vs_sma:6 rsi_state macd_crossover:i"
_IND_SQL = f"WITH {S.DAILY_SPLIT}, {S.MACRO}, {S.features()}"


@query("technical_indicators", _INDICATORS, f"{_IND_SQL} SELECT * FROM f4")
def technical_indicators(spark, sf_dir):
    return features.technical_indicators(stage(T.daily(spark, sf_dir), "daily"))


@query("rsi_state", "series_id ts:t rsi_14:6 rsi_state", f"{_IND_SQL} SELECT * FROM f4")
def rsi_state(spark, sf_dir):
    from barloom.operators.ewm import rsi

    return rsi(T.daily(spark, sf_dir)).withColumn("rsi_state", C.rsi_state("rsi_14"))


@query("macd_crossover", "series_id ts:t macd_crossover:i", f"{_IND_SQL} SELECT * FROM f4")
def macd_crossover(spark, sf_dir):
    from barloom.operators.ewm import macd

    return macd(T.daily(spark, sf_dir)).withColumn("macd_crossover", C.crossover("macd_12_26_9", "macd_signal_12_26_9"))


@query("price_vs_sma", "series_id ts:t price_vs_sma:6", f"{_IND_SQL} SELECT * FROM f4")
def price_vs_sma(spark, sf_dir):
    from barloom.operators.ordered import rolling_mean

    rows = rolling_mean(T.daily(spark, sf_dir), {"sma_50": ("close", 50)})
    return rows.withColumn("price_vs_sma", F.try_divide("close", "sma_50"))


@query("feature_table", S.FEATURE_SPEC + " split", f"WITH {S.FEATURES} SELECT * FROM features")
def feature_table(spark, sf_dir):
    return feature_rows(spark, sf_dir)


_MODEL_COLUMNS = " ".join(
    ["series_id ts:t rsi_state"] + [t for t in S.FEATURE_SPEC.split() if t.partition(":")[0] in S.NUMERIC]
)


@query("model_columns", _MODEL_COLUMNS, f"WITH {S.FEATURES} SELECT * FROM features")
def model_columns(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    numeric, categorical = features.model_columns(rows.columns)
    return rows.select(KEY, TS, *numeric, *categorical)


def _z(c: str) -> str:
    mean = f"avg(CASE WHEN split = 'train' THEN {c} END) OVER (PARTITION BY series_id)"
    std = f"stddev_pop(CASE WHEN split = 'train' THEN {c} END) OVER (PARTITION BY series_id)"
    return f"({c} - {mean}) / (CASE WHEN {std} = 0 THEN 1 ELSE {std} END)"


_Z = ", ".join(f"{_z(c)} AS z_{c}" for c in S.NUMERIC)
_STATES = ("Neutral", "Overbought", "Oversold")
_HOT = ", ".join(
    f"""CASE WHEN rsi_state = '{l}' AND count(CASE WHEN split = 'train' AND rsi_state = '{l}' THEN 1 END)
  OVER (PARTITION BY series_id) > 0 THEN 1.0 ELSE 0.0 END AS state_{l}"""
    for l in _STATES
)


@query(
    "standard_scale",
    "series_id ts:t split " + " ".join(f"z_{c}:6" for c in S.NUMERIC),
    f"WITH {S.FEATURES} SELECT series_id, ts, split, {_Z} FROM features",
)
def standard_scale(spark, sf_dir):
    return datasets.standard_scale(staged_features(spark, sf_dir), S.NUMERIC)


@query(
    "one_hot_state",
    "series_id ts:t rsi_state " + " ".join(f"state_{l}:1" for l in _STATES),
    f"WITH {S.FEATURES} SELECT series_id, ts, rsi_state, {_HOT} FROM features",
)
def one_hot_state(spark, sf_dir):
    return datasets.one_hot_state(staged_features(spark, sf_dir))


# Scaled rows ``zz`` with the sum and first and last entries of each row vector.
_ZZ = f"""{S.FEATURES}, z0 AS (SELECT series_id, ts, pos, split, close, log_returns_close, {_Z}, {_HOT} FROM features),
zz AS (SELECT series_id, ts, pos, split, close, log_returns_close AS target, z_log_returns_close AS z, z_log_returns_open AS x_first,
  state_Oversold AS x_last, {' + '.join([f'z_{c}' for c in S.NUMERIC] + [f'state_{l}' for l in _STATES])} AS x_sum,
  avg(CASE WHEN split = 'train' THEN log_returns_close END) OVER (PARTITION BY series_id) AS mean,
  stddev_pop(CASE WHEN split = 'train' THEN log_returns_close END) OVER (PARTITION BY series_id) AS std FROM z0)"""


def _digest(column: str):
    """Length, sum and end entries of a flat feature array."""
    return {
        "size": F.size(column),
        "total": F.aggregate(column, F.lit(0.0), lambda a, v: a + v),
        "first": F.element_at(column, 1),
        "last": F.element_at(column, -1),
    }


@query(
    "lag_feature_table",
    "series_id ts:t split size:i total:4 first:6 last:6 label_1:6 label_7:6",
    f"""WITH {_ZZ} SELECT *, {WINDOW} * 20 AS size, sum(x_sum) OVER {S.rows(WINDOW - 1)} AS total,
    lag(x_first, {WINDOW - 1}) OVER {S.W} AS first, x_last AS last,
    CASE WHEN lag(split, {WINDOW - 1}) OVER {S.W} = lead(split, 1) OVER {S.W} THEN lead(z, 1) OVER {S.W} END AS label_1,
    CASE WHEN lag(split, {WINDOW - 1}) OVER {S.W} = lead(split, 7) OVER {S.W} THEN lead(z, 7) OVER {S.W} END AS label_7
    FROM zz QUALIFY count(*) OVER {S.rows(WINDOW - 1)} = {WINDOW}""",
)
def lag_feature_table(spark, sf_dir):
    table = datasets.lag_feature_table(matrix(spark, sf_dir), WINDOW, [1, 7])
    return table.withColumns(_digest("features"))


@query(
    "lag_feature_table_cumulative",
    "series_id ts:t split label_1:6 label_7:6",
    f"""WITH {_ZZ} SELECT *, CASE WHEN lag(split, {WINDOW - 1}) OVER {S.W} = lead(split, 1) OVER {S.W} THEN lead(z, 1) OVER {S.W} END AS label_1,
    CASE WHEN lag(split, {WINDOW - 1}) OVER {S.W} = lead(split, 7) OVER {S.W} THEN {' + '.join(f'lead(z, {k}) OVER {S.W}' for k in range(1, 8))} END AS label_7
    FROM zz QUALIFY count(*) OVER {S.rows(WINDOW - 1)} = {WINDOW}""",
)
def lag_feature_table_cumulative(spark, sf_dir):
    """Labels over the whole way to the horizon."""
    return datasets.lag_feature_table(matrix(spark, sf_dir), WINDOW, [1, 7], label="cumulative")


@query(
    "seq2seq_windows",
    "series_id ts:t split inputs_total:4 first_target:6 first_row_total:4 last_row_total:4 last_target:6 rows:i width:i",
    f"""WITH {_ZZ} SELECT *, sum(x_sum) OVER {S.rows(WINDOW - 1)} AS inputs_total,
    lag(z, {WINDOW - 2}) OVER {S.W} AS first_target,
    sum(z) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {WINDOW - 2} PRECEDING AND {5 - (WINDOW - 1)} FOLLOWING) AS first_row_total,
    sum(z) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS last_row_total,
    lead(z, 5) OVER {S.W} AS last_target, {WINDOW} AS rows, 5 AS width
    FROM zz QUALIFY lag(split, {WINDOW - 1}) OVER {S.W} = lead(split, 5) OVER {S.W}""".replace("AND -1 FOLLOWING", "AND 1 PRECEDING"),
)
def seq2seq_windows(spark, sf_dir):
    w = datasets.seq2seq_windows(matrix(spark, sf_dir), WINDOW, 5)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    return w.withColumns(
        {
            "inputs_total": total(F.flatten("inputs")),
            "first_target": F.col("targets")[0][0],
            "first_row_total": total(F.col("targets")[0]),
            "last_row_total": total(F.element_at("targets", -1)),
            "last_target": F.element_at(F.element_at("targets", -1), -1),
            "rows": F.size("targets"),
            "width": F.size(F.col("targets")[0]),
        }
    )


def _walk_sql(late: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY pos ROWS BETWEEN {WINDOW - 1 + late} PRECEDING AND {late} PRECEDING)"
    return f"""WITH {_ZZ}, x AS (SELECT series_id, lead(ts, {H}) OVER {S.W} AS ts, split, lead(split, {H}) OVER {S.W} AS to_split,
    {WINDOW} * 20 AS size, sum(x_sum) OVER {frame} AS total, count(*) OVER {frame} AS c,
    lag(x_first, {WINDOW - 1 + late}) OVER {S.W} AS first, lag(x_last, {late}) OVER {S.W} AS last,
    lead(close, {H}) OVER {S.W} AS "true", close AS base, lead(target, {H}) OVER {S.W} AS true_return, mean, std FROM zz)
    SELECT * FROM x WHERE split = 'test' AND to_split = 'test' AND c = {WINDOW}"""


_WALK = "series_id ts:t size:i total:4 first:6 last:6 true:4 base:4 true_return:6 mean:8 std:8"


@query("walk_forward_frames", _WALK, _walk_sql(0))
def walk_forward_frames(spark, sf_dir):
    return datasets.walk_forward_frames(matrix(spark, sf_dir), WINDOW, H, "test").withColumns(_digest("features"))


@query("walk_forward_frames_early", _WALK, _walk_sql(1))
def walk_forward_frames_early(spark, sf_dir):
    """Histories that end one row before the base row."""
    frames = datasets.walk_forward_frames(matrix(spark, sf_dir), WINDOW, H, "test", "reference")
    return frames.withColumns(_digest("features"))


_SCALED = f"""{_ZZ}, sc AS (SELECT series_id, pos, z AS scaled, ts, close, target, mean, std, split FROM zz),
x AS (SELECT series_id, lead(ts, {H}) OVER {S.W} AS ts, lead(pos, {H}) OVER {S.W} AS pos, lead(close, {H}) OVER {S.W} AS "true",
  close AS base, scaled, mean, std, lead(target, {H}) OVER {S.W} AS true_return, split, lead(split, {H}) OVER {S.W} AS to_split FROM sc),
y AS (SELECT *, base * exp(scaled * std + mean) AS pred, scaled * std + mean AS pred_return FROM x WHERE split = 'test' AND to_split = 'test')"""


def external_predictions(spark, sf_dir):
    """Scaled predictions made elsewhere: here, the scaled return of the base row."""
    m = matrix(spark, sf_dir)
    frames = datasets.walk_forward_frames(m, WINDOW, H, "test")
    scaled = m.select(KEY, (F.col(POS) + H).alias(POS), F.col("z").alias("scaled"))
    return forecasters.score_external(scaled, frames, "external")


@query("price_from_log_return", "series_id ts:t true:4 pred:4 base:4", f"WITH {_SCALED} SELECT * FROM y")
def price_from_log_return(spark, sf_dir):
    return external_predictions(spark, sf_dir)


EXTERNAL_SQL = _SCALED
STEPS = ("log_returns_close", "log_returns_volume", "rsi_14")
# Rows ``zr`` with the scaled return, 1 or 0 for columns above or below their mean, and the scale, fitted on train.
SCALED_ROWS = f"""{S.FEATURES}, zr AS (SELECT series_id, ts, pos, split, close, log_returns_close AS target, {_z('log_returns_close')} AS z,
  {', '.join(f"CASE WHEN {_z(c)} > 0 THEN 1.0 ELSE 0.0 END AS up_{c}" for c in STEPS)},
  avg(CASE WHEN split = 'train' THEN log_returns_close END) OVER (PARTITION BY series_id) AS mean,
  stddev_pop(CASE WHEN split = 'train' THEN log_returns_close END) OVER (PARTITION BY series_id) AS std FROM features)"""
