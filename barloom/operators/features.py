"""Technical indicators and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import crossover, finite_or_null, range_pct, rsi_state
from barloom.operators.bars import BAR_COLUMNS
from barloom.operators.ewm import macd_reach, rsi_and_macd_columns, rsi_reach
from barloom.operators.joins import MACRO_COLUMNS, join_macro
from barloom.operators.ordered import log_return, rolling_mean_of, signed_volume, true_range
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, TS, accumulate, over_blocks, running_total
from barloom.plans.staging import stage

INDICATORS = [
    "sma_50", "rsi_14", "atr_14", "obv", "macd_12_26_9", "macd_signal_12_26_9", "macd_hist_12_26_9",
    "price_vs_sma", "rsi_state", "macd_crossover",
]
LOG_COLUMNS = [f"log_{c}" for c in BAR_COLUMNS]
RETURN_COLUMNS = [f"log_returns_{c}" for c in BAR_COLUMNS]


def model_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical model columns: bars and their logs are left out."""
    unused = {KEY, TS, POS, "split", *BAR_COLUMNS, *LOG_COLUMNS}
    rest = [c for c in columns if c not in unused]
    return [c for c in rest if c != "rsi_state"], [c for c in rest if c == "rsi_state"]


def _frame_indicators(t: DataFrame, sma: int, rsi: int, atr: int) -> DataFrame:
    t = t.withColumns({f"sma_{sma}": rolling_mean_of("close", sma), "_tr": true_range(), "_signed": signed_volume()})
    t = t.withColumn(f"atr_{atr}", rolling_mean_of("_tr", atr)).drop("_tr")
    return rsi_and_macd_columns(t, rsi, 12, 26, 9)


def _relations(sma: int, rsi: int) -> dict:
    return {
        "price_vs_sma": F.try_divide("close", f"sma_{sma}"),
        "rsi_state": rsi_state(f"rsi_{rsi}"),
        "macd_crossover": crossover("macd_12_26_9", "macd_signal_12_26_9"),
    }


def technical_indicators(
    df: DataFrame, sma: int = 50, rsi: int = 14, atr: int = 14, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All indicators in one spread of the table; only the volume balance needs a carry."""
    reach = max(sma, atr + 1, rsi_reach(rsi), macd_reach(26, 9))
    framed = over_blocks(df, lambda t: _frame_indicators(t, sma, rsi, atr), behind=reach, block_rows=block_rows)
    # The frames are computed once; block totals and rows both read the staged result.
    return (
        running_total(stage(framed, "frames"), {"_obv": "_signed"}, block_rows)
        .withColumns({"obv": F.when(F.col("_signed").isNotNull(), F.col("_obv")), **_relations(sma, rsi)})
        .drop("_signed", "_obv")
    )


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and NaN to null, then drop rows with a null in ``columns``."""
    numeric = [c for c, t in df.dtypes if c in columns and t == "double"]
    return df.withColumns({c: finite_or_null(c) for c in numeric}).na.drop(subset=columns)


def feature_table(df: DataFrame, macro: DataFrame, columns: list[str] = BAR_COLUMNS, block_rows: int = BLOCK_ROWS):
    """Bars (numbered, with ``split``) to features: returns, range, indicators, macro values,
    infinities to null, last value forward, incomplete head rows dropped."""

    def framed(t: DataFrame) -> DataFrame:
        logs = {f"log_{c}": F.log(c) for c in columns} | {f"log_returns_{c}": log_return(c) for c in columns}
        t = t.withColumns(logs | {"price_range_pct": range_pct()})
        return _frame_indicators(t, 50, 14, 14)

    wide = over_blocks(df, framed, behind=macd_reach(26, 9), block_rows=block_rows)
    wide = wide.withColumns({**_relations(50, 14), "_moved": F.col("_signed").isNotNull().cast("int")})
    wide = join_macro(wide, macro)
    logs = [f"{p}_{c}" for c in columns for p in ("log", "log_returns")]
    made = [*logs, "price_range_pct", *[i for i in INDICATORS if i != "obv"]]
    numeric = [c for c, t in wide.dtypes if t == "double"]
    # The frames are computed once; sums and last values both read the staged result.
    clean = stage(wide.withColumns({c: finite_or_null(c) for c in numeric}), "frames")
    filled = accumulate(
        clean, {"_obv": "_signed", "_moves": "_moved"}, [*BAR_COLUMNS, *made, *MACRO_COLUMNS], block_rows
    )
    # Carried forward, the volume balance is its running sum from the first move on.
    filled = filled.withColumn("obv", F.when(F.col("_moves") > 0, F.col("_obv")))
    filled = filled.na.fill(0.0, subset=MACRO_COLUMNS)
    required = [*BAR_COLUMNS, *logs, "price_range_pct", *INDICATORS]
    order = [c for c in (KEY, TS, POS, "split") if c in filled.columns] + [*required, *MACRO_COLUMNS]
    return filled.na.drop(subset=required).select(*order)
