"""Exponentially weighted means, RSI and MACD.

The weights are those of the adjusted form: y = sum(q^k x) / sum(q^k) over all
earlier rows k steps back, nulls skipped but counted as steps.  Both sums are
affine in what came before: rows d steps apart, S(i) = q^d S(i - d) + s(i).  So a
block is reduced to one row (its sums at its last value and where that is), a scan
over those rows composes them, and each row adds the state before its block,
decayed by its distance.  No row is copied, whatever the span.

Inside a run of rows both sums are running sums of ``x * q^-j``; a run is so long
that what lies before the one before it is below the smallest double, as far as
the block allows.  The scan over blocks works the same way.

Tables of many indicators (``features``) use frames over copied rows instead: the
weights of the usual indicators underflow within a fifth of a block, and one
spread serves them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ordered import difference
from barloom.plans.blocks import BLOCK, BLOCK_ROWS, KEY, POS, block_of, over_blocks, spread
from barloom.plans.staging import stage

_LOG_SMALLEST = 745.0  # -ln of the smallest positive double
_LOG_SAFE = 500.0  # largest exponent used on either side of a run's middle
_ALIKE = 4.0  # weights whose steepness differs less share their runs


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def memory_rows(alpha: float) -> int:
    """Rows after which a weight underflows to zero."""
    return math.ceil(_LOG_SMALLEST / -math.log1p(-alpha)) + 1


def steepness(alpha: float) -> float:
    """-ln of the weight's factor for one step."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return -math.log1p(-alpha)


def _run_rows(steep: float) -> int:
    return max(1, int(2 * _LOG_SAFE / steep))


def _alike(outputs: dict[str, tuple[str, float]]) -> list[dict[str, tuple[str, float]]]:
    """Outputs that can share their runs, steepest first."""
    groups: list[dict[str, tuple[str, float]]] = []
    for out, spec in sorted(outputs.items(), key=lambda o: -steepness(o[1][1])):
        if groups and steepness(next(iter(groups[-1].values()))[1]) < _ALIKE * steepness(spec[1]):
            groups[-1][out] = spec
        else:
            groups.append({out: spec})
    return groups


def _block_sums(t: DataFrame, outputs: dict[str, tuple[str, float]]) -> DataFrame:
    """Add ``_u_out`` and ``_w_out``, the sums over the block's rows so far, to a table with blocks."""
    for group in _alike(outputs):
        t = _sums_by_runs(t, group)
    return t


def _sums_by_runs(t: DataFrame, outputs: dict[str, tuple[str, float]]) -> DataFrame:
    kept = t.columns
    run = _run_rows(steepness(next(iter(outputs.values()))[1]))  # the steepest comes first
    j = (F.col(POS) - 1) % run
    t = t.withColumns({"_run": F.floor((F.col(POS) - 1) / F.lit(run)), "_j": j.cast("double")})
    inside = Window.partitionBy(KEY, BLOCK, "_run").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    sums, ends, totals = {}, {}, {}
    for out, (c, alpha) in outputs.items():
        q = F.lit(1.0 - alpha)
        grow = F.pow(q, F.lit(run // 2) - F.col("_j"))
        shrink = F.pow(q, F.col("_j") - run // 2)
        x = F.col(c)
        sums[f"_u_{out}"] = F.coalesce(F.sum(x * grow).over(inside), F.lit(0.0)) * shrink
        sums[f"_w_{out}"] = F.coalesce(F.sum(F.when(x.isNotNull(), grow)).over(inside), F.lit(0.0)) * shrink
    for name in sums:
        ends[f"{name}_end"] = F.when(F.col("_j") == run - 1, F.col(name))
    for out, (_, alpha) in outputs.items():
        q = 1.0 - alpha
        runs_back = math.ceil(_LOG_SMALLEST / (run * steepness(alpha)))
        for name in (f"_u_{out}", f"_w_{out}"):
            earlier = " + ".join(
                f"coalesce(lag(`{name}_end`, {k}) IGNORE NULLS OVER "
                f"(PARTITION BY {KEY}, {BLOCK} ORDER BY {POS}), 0D) * {q ** (run * (k - 1))!r}D"
                for k in range(1, runs_back + 1)
            )
            totals[name] = F.expr(f"`{name}` + ({earlier}) * pow({q!r}D, _j + 1)")
    return t.withColumns(sums).withColumns(ends).withColumns(totals).select(*[c for c in kept if c not in totals], *totals)


def add_ewm(t: DataFrame, outputs: dict[str, tuple[str, float]]) -> DataFrame:
    """Frame columns ``{new column: (column, alpha)}`` on a table spread by ``memory_rows``."""
    kept = t.columns
    means = {out: F.try_divide(f"_u_{out}", f"_w_{out}") for out in outputs}
    return _block_sums(t, outputs).withColumns(means).select(*[c for c in kept if c not in means], *means)


def _states_before(ends: DataFrame, outputs: dict[str, tuple[str, float]]) -> DataFrame:
    """``_before_out`` = (u, w, p): the sums at the last value before each block, and its position.

    ``ends`` has a row for each block: ``_last_out`` = (u, w, p) of the block's own rows, null without a value.
    """
    in_order = Window.partitionBy(KEY).orderBy(BLOCK)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    names = list(ends.columns)
    for out, (_, alpha) in outputs.items():
        q, reach = F.lit(1.0 - alpha), _run_rows(steepness(alpha))
        last = F.col(f"_last_{out}")
        ends = ends.withColumn("_g", F.floor(last["p"] / F.lit(reach)))
        group = Window.partitionBy(KEY, "_g")
        so_far = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
        j = (last["p"] % reach).cast("double")
        grow, shrink = F.pow(q, F.lit(reach // 2) - j), F.pow(q, j - reach // 2)
        ends = ends.withColumns({f"_s{k}": F.sum(last[k] * grow).over(so_far) * shrink for k in "uw"})
        # what lies more than one group back has decayed to nothing
        closed = F.when(F.max(last["p"]).over(group) == last["p"], F.struct(F.col("_su").alias("u"), F.col("_sw").alias("w"), last["p"].alias("p")))
        ends = ends.withColumn("_end", closed).withColumn("_prev", F.last("_end", True).over(earlier))
        decay = F.pow(q, (last["p"] - F.col("_prev.p")).cast("double"))
        full = [(F.col(f"_s{k}") + F.coalesce(F.col(f"_prev.{k}") * decay, F.lit(0.0))).alias(k) for k in "uw"]
        ends = ends.withColumn("_state", F.when(last.isNotNull(), F.struct(*full, last["p"].alias("p"))))
        ends = ends.withColumn(f"_before_{out}", F.last("_state", True).over(earlier))
        names.append(f"_before_{out}")
        ends = ends.select(*names)
    return ends.select(KEY, BLOCK, *[f"_before_{out}" for out in outputs])


def weighted_means(
    df: DataFrame, outputs: dict[str, tuple[str, float]], block_rows: int = BLOCK_ROWS, frame=None, behind: int = 0
) -> DataFrame:
    """``df`` with means ``{new column: (column, alpha)}``; at nulls the last mean stands.

    ``frame`` first adds columns that need up to ``behind`` earlier rows.  One shuffle by block; its result is staged, as
    the scan reads the ends of blocks and the rows read the scan.
    """
    t = spread(df, behind, block_rows=block_rows)
    t = frame(t) if frame else t
    t = t.where(F.col(BLOCK) == block_of(POS, block_rows))
    kept = [c for c in t.columns if c not in outputs and c != BLOCK]
    here = Window.partitionBy(KEY, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    t = _block_sums(t, outputs)
    at_values = {
        f"_last_{out}": F.last(
            F.when(F.col(c).isNotNull(), F.struct(F.col(f"_u_{out}").alias("u"), F.col(f"_w_{out}").alias("w"), F.col(POS).alias("p"))), True
        ).over(here)
        for out, (c, _) in outputs.items()
    }
    local = stage(t.withColumns(at_values).select(*kept, BLOCK, *at_values), "block-sums")
    ends = local.groupBy(KEY, BLOCK).agg(*[F.max_by(name, POS).alias(name) for name in at_values])
    rows = local.join(_states_before(ends, outputs), [KEY, BLOCK])
    means = {}
    for out, (_, alpha) in outputs.items():
        own, before = F.col(f"_last_{out}"), F.col(f"_before_{out}")
        decay = F.pow(F.lit(1.0 - alpha), (own["p"] - before["p"]).cast("double"))
        u, w = (own[k] + F.coalesce(before[k] * decay, F.lit(0.0)) for k in "uw")
        means[out] = F.coalesce(u / w, before["u"] / before["w"])
    return rows.withColumns(means).select(*kept, *means)


def ewm_mean(df: DataFrame, outputs: dict[str, tuple[str, float]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exponentially weighted means of numbered columns; at nulls the last mean stands."""
    return weighted_means(df, outputs, block_rows)


def gains_and_losses(t: DataFrame) -> DataFrame:
    """Frame columns ``_gain`` and ``_loss`` of the close."""
    move = difference("close")
    t = t.withColumn("_move", move)
    gain, loss = F.greatest("_move", F.lit(0.0)), F.greatest(-F.col("_move"), F.lit(0.0))
    known = F.col("_move").isNotNull()
    return t.withColumns({"_gain": F.when(known, gain), "_loss": F.when(known, loss)}).drop("_move")


def strength_index(up: str, down: str) -> Column:
    """Index of mean gain and mean loss; loss 0 with a gain gives 100, 0/0 null."""
    u, d = F.col(up), F.col(down)
    return F.when((d == 0) & (u > 0), 100.0).when(d > 0, 100 - 100 / (1 + u / d))


def add_signal(t: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """Line, signal and histogram from the means ``_fast`` and ``_slow``."""
    tag = f"{fast}_{slow}_{signal}"
    t = t.withColumn(f"macd_{tag}", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    t = add_ewm(t, {f"macd_signal_{tag}": (f"macd_{tag}", span_alpha(signal))})
    return t.withColumn(f"macd_hist_{tag}", F.col(f"macd_{tag}") - F.col(f"macd_signal_{tag}"))


def rsi_and_macd_columns(t: DataFrame, rows: int, fast: int, slow: int, signal: int) -> DataFrame:
    """Both indicators with one set of running sums for all means of the first level."""
    means = {
        "_up": ("_gain", 1.0 / rows),
        "_down": ("_loss", 1.0 / rows),
        "_fast": ("close", span_alpha(fast)),
        "_slow": ("close", span_alpha(slow)),
    }
    t = add_ewm(gains_and_losses(t), means).withColumn(f"rsi_{rows}", strength_index("_up", "_down"))
    return add_signal(t.drop("_gain", "_loss", "_up", "_down"), fast, slow, signal)


def rsi_reach(rows: int) -> int:
    return memory_rows(1.0 / rows) + 1


def macd_reach(slow: int, signal: int) -> int:
    return memory_rows(span_alpha(slow)) + memory_rows(span_alpha(signal))


def rsi(df: DataFrame, rows: int = 14, block_rows: int = BLOCK_ROWS) -> DataFrame:
    means = {"_up": ("_gain", 1.0 / rows), "_down": ("_loss", 1.0 / rows)}
    t = weighted_means(df, means, block_rows, gains_and_losses, behind=1)
    return t.withColumn(f"rsi_{rows}", strength_index("_up", "_down")).drop("_gain", "_loss", "_up", "_down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The signal is a mean of the line, so it takes a scan of its own."""
    tag = f"{fast}_{slow}_{signal}"
    t = weighted_means(df, {"_fast": ("close", span_alpha(fast)), "_slow": ("close", span_alpha(slow))}, block_rows)
    t = t.withColumn(f"macd_{tag}", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    t = weighted_means(t, {f"macd_signal_{tag}": (f"macd_{tag}", span_alpha(signal))}, block_rows)
    return t.withColumn(f"macd_hist_{tag}", F.col(f"macd_{tag}") - F.col(f"macd_signal_{tag}"))
