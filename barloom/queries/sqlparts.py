"""Building blocks of the SQL checks."""

from __future__ import annotations

from barloom.functions.probability import QUANTILE_FAR, QUANTILE_MIDDLE, QUANTILE_TAIL

BARS = "series_id ts:t open:4 high:4 low:4 close:4 volume:4"

_AGG = """arg_min({p}, {o}) AS open, max({p}) AS high, min({p}) AS low, arg_max({p}, {o}) AS close,
  CAST(count(*) AS DOUBLE) AS volume"""

DAILY_BARS = f"""daily_bars AS (SELECT 'orders' AS series_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
  {_AGG.format(p='o_totalprice', o='o_orderkey')} FROM orders GROUP BY 1, 2)"""
DAILY = f"{DAILY_BARS}, d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos FROM daily_bars)"


def event_bars(unit: str, name: str) -> str:
    return f"""{name}_bars AS (SELECT event_type AS series_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts,
  {_AGG.format(p='value', o='event_id')} FROM events GROUP BY 1, 2)"""


HOURLY = event_bars("hour", "h") + (
    ", h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos FROM h_bars)"
)
MINUTES = event_bars("minute", "m") + (
    ", m AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos FROM m_bars)"
)


def grid(unit: str, bars: str, name: str) -> str:
    return f"""{name} AS (SELECT g.series_id, g.ts, b.open, b.high, b.low, b.close, b.volume,
  row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) AS pos
  FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 {unit})) AS ts FROM {bars} GROUP BY series_id) AS g
  LEFT JOIN {bars} AS b ON b.series_id = g.series_id AND b.ts = g.ts)"""


W = "(PARTITION BY series_id ORDER BY pos)"


def rows(before: int, after: int = 0, part: str = "series_id", order: str = "pos") -> str:
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


def roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n - 1)} = {n} THEN {fn}({x}) OVER {rows(n - 1)} END"


def ewm(x: str, alpha: float) -> str:
    q = repr(1.0 - alpha)
    return (
        f"sum({x} * pow(CAST({q} AS DOUBLE), -pos)) OVER {W} / "
        f"sum(CASE WHEN {x} IS NOT NULL THEN pow(CAST({q} AS DOUBLE), -pos) END) OVER {W}"
    )


def ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


SPLIT = """s AS (SELECT *, CASE WHEN pos <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
  WHEN pos <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM d) AS c)"""
DAILY_SPLIT = f"{DAILY}, {SPLIT}"

MACRO = """rate AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) * 100 AS fed_rate
  FROM lineitem GROUP BY 1),
supply AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) AS m2_supply
  FROM lineitem GROUP BY 1),
months AS (SELECT rate.month, fed_rate, m2_supply FROM rate JOIN supply ON rate.month = supply.month),
macro AS (SELECT month, fed_rate,
  (lag(m2_supply, 1) OVER (ORDER BY month) / lag(m2_supply, 2) OVER (ORDER BY month) - 1) * 100 AS m2_supply_mom_pct
  FROM months)"""


def predictions(h: int, split: str, source: str = "s", name: str = "p") -> str:
    """Persistence and two trailing means, h rows ahead, targets and bases in one split."""
    w = "(PARTITION BY series_id ORDER BY pos)"

    def one(model: str, value: str) -> str:
        return f"""SELECT series_id, '{model}' AS model, ts, pos, close AS "true", lag(v, {h}) OVER {w} AS pred,
  lag(close, {h}) OVER {w} AS base, split, lag(split, {h}) OVER {w} AS from_split
  FROM (SELECT *, {value} AS v FROM {source}) AS x_{model}"""

    union = " UNION ALL ".join(
        one(m, v)
        for m, v in (
            ("persistence", "close"),
            ("mean_7", roll("avg", "close", 7)),
            ("mean_30", roll("avg", "close", 30)),
        )
    )
    return f"""{name} AS (SELECT series_id, model, ts, pos, "true", pred, base FROM ({union}) AS u_{name}
  WHERE split = '{split}' AND from_split = '{split}' AND pred IS NOT NULL)"""


def mape_sql(true: str = '"true"', pred: str = "pred") -> str:
    return f"avg(abs({true} - {pred}) / greatest(abs({true}), 2.220446049250313e-16)) * 100"


def normal_quantile(p: str) -> str:
    def ratio(coefficients, r: str) -> str:
        parts = [" + ".join(f"CAST({v!r} AS DOUBLE) * pow({r}, {7 - k})" for k, v in enumerate(side)) for side in coefficients]
        return f"(({parts[0]}) / ({parts[1]}))"

    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {far} <= 5 THEN {ratio(QUANTILE_TAIL, f'({far} - 1.6)')} ELSE {ratio(QUANTILE_FAR, f'({far} - 5)')} END"
    middle = f"({p} - 0.5) * {ratio(QUANTILE_MIDDLE, f'(0.180625 - pow({p} - 0.5, 2))')}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {middle} ELSE sign({p} - 0.5) * ({tail}) END"


_A14 = 1.0 / 14


def features(source: str = "s", extra: str = "split") -> str:
    """Feature table of a numbered bar table, up to the dropped head rows (``features``)."""
    cols = ["open", "high", "low", "close", "volume"]
    logs = ", ".join(f"ln({c}) AS log_{c}, ln({c}) - lag(ln({c})) OVER {W} AS log_returns_{c}" for c in cols)
    made = [f"log_{c}" for c in cols] + [f"log_returns_{c}" for c in cols]
    made += ["price_range_pct", "sma_50", "rsi_14", "atr_14", "obv", "macd_12_26_9", "macd_signal_12_26_9"]
    made += ["macd_hist_12_26_9", "price_vs_sma", "rsi_state"]
    keep = ", ".join(["series_id", "ts", "pos", extra, *cols])
    return f"""f0 AS (SELECT {keep}, {logs}, (high - low) / open AS price_range_pct,
  {roll('avg', 'close', 50)} AS sma_50,
  greatest(high - low, abs(high - lag(close) OVER {W}), abs(lag(close) OVER {W} - low)) AS tr,
  close - lag(close) OVER {W} AS move FROM {source}),
f1 AS (SELECT *, {roll('avg', 'tr', 14)} AS atr_14,
  CASE WHEN move > 0 THEN move WHEN move <= 0 THEN 0.0 END AS gain, CASE WHEN move < 0 THEN -move WHEN move >= 0 THEN 0.0 END AS loss,
  CASE WHEN move > 0 THEN volume WHEN move < 0 THEN -volume END AS signed,
  {ewm('close', 2 / 13)} - {ewm('close', 2 / 27)} AS macd_12_26_9 FROM f0),
f2 AS (SELECT *, {ewm('gain', _A14)} AS up, {ewm('loss', _A14)} AS down, {ewm('macd_12_26_9', 0.2)} AS macd_signal_12_26_9,
  CASE WHEN signed IS NOT NULL THEN sum(signed) OVER {W} END AS obv FROM f1),
f3 AS (SELECT *, CASE WHEN down = 0 AND up > 0 THEN 100.0 WHEN down > 0 THEN 100 - 100 / (1 + up / down) END AS rsi_14,
  macd_12_26_9 - macd_signal_12_26_9 AS macd_hist_12_26_9, close / sma_50 AS price_vs_sma,
  CASE WHEN macd_12_26_9 > macd_signal_12_26_9 THEN 1 ELSE 0 END AS macd_crossover FROM f2),
f4 AS (SELECT *, CASE WHEN rsi_14 >= 0 AND rsi_14 < 30 THEN 'Oversold' WHEN rsi_14 >= 30 AND rsi_14 < 70 THEN 'Neutral'
  WHEN rsi_14 >= 70 AND rsi_14 < 100 THEN 'Overbought' END AS rsi_state FROM f3),
f5 AS (SELECT {keep}, macd_crossover, {', '.join(f'{ffill(c)} AS {c}' for c in made)},
  coalesce({ffill('fed_rate')}, 0) AS fed_rate, coalesce({ffill('m2_supply_mom_pct')}, 0) AS m2_supply_mom_pct
  FROM f4 LEFT JOIN macro ON macro.month = CAST(date_trunc('month', f4.ts) AS DATE)),
features AS (SELECT * FROM f5 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in made)})"""


FEATURE_SPEC = (
    "series_id ts:t close:4 log_open:6 log_high:6 log_low:6 log_close:6 log_volume:6 log_returns_open:6 "
    "log_returns_high:6 log_returns_low:6 log_returns_close:6 log_returns_volume:6 price_range_pct:6 sma_50:4 "
    "rsi_14:6 atr_14:4 obv:4 macd_12_26_9:3 macd_signal_12_26_9:3 macd_hist_12_26_9:3 price_vs_sma:6 rsi_state "
    "macd_crossover:i fed_rate:6 m2_supply_mom_pct:6"
)
NUMERIC = [
    "log_returns_open", "log_returns_high", "log_returns_low", "log_returns_close", "log_returns_volume",
    "price_range_pct", "sma_50", "rsi_14", "atr_14", "obv", "macd_12_26_9", "macd_signal_12_26_9",
    "macd_hist_12_26_9", "price_vs_sma", "macd_crossover", "fed_rate", "m2_supply_mom_pct",
]
FEATURES = f"{DAILY_SPLIT}, {MACRO}, {features()}"
