"""Exact interpolated quantiles without collecting a group.

The built-in exact percentile keeps all distinct values of a group in one task.
Here a mergeable sketch first brackets each wanted rank; then only the values in
the bracket are counted, ranked and picked.  The result is exact: the counts below
a bracket are taken from the data.  Where a bracket misses its rank, all are
widened and tried again, at last to the whole range; counted values are ranked by
ranges (``plans.ranges``), so no task sorts a bracket of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import BLOCK, BLOCK_ROWS, KEY, POS, by_block, with_block
from barloom.plans.ranges import RANGE_ROWS, running_counts
from barloom.plans.staging import stage

SKETCH_ACCURACY = 100_000
_WIDER = 8.0


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    quantiles: dict[str, tuple[str, float]],
    accuracy: int = SKETCH_ACCURACY,
    block_rows: int = BLOCK_ROWS,
    registry: DataFrame | None = None,
    margin: float | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per group with linear-interpolated quantiles ``{name: (column, probability)}``.

    All columns share the two passes.  Nulls are left out per column.  ``margin`` is the share of ranks on either side of a
    quantile that its first bracket holds.
    """
    margin = 3.0 / accuracy if margin is None else margin
    while True:
        picked = _picked(df, keys, quantiles, accuracy, margin, block_rows, registry, range_rows)
        if margin >= 1.0 or picked.where("_missed").isEmpty():
            names = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(quantiles)]
            return picked.groupBy(*keys).agg(*names)
        margin = max(_WIDER * margin, 1.0 / accuracy)


def _picked(df, keys, quantiles, accuracy, margin, block_rows, registry, range_rows) -> DataFrame:
    """``(keys, _i, _q, _missed)``: each quantile, or that its rank lies outside its bracket."""
    specs = [(name, c, float(p)) for name, (c, p) in quantiles.items()]
    columns = sorted({c for _, c, _ in specs})
    sketches = [F.max(POS).alias("_last")]
    for c in columns:
        probs = [p for _, col, p in specs if col == c]
        wide = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
        sketches += [F.count(c).alias(f"_n_{c}"), F.percentile_approx(c, wide, accuracy).alias(f"_cut_{c}")]
    brackets = df.groupBy(*keys).agg(*sketches)
    if keys == [KEY]:
        # One row per block of the series, so that a hot series is many join keys.
        copies = by_block(brackets, "_last", block_rows, registry)
        joined = with_block(df.select(*keys, POS, *columns), block_rows).join(copies, [KEY, BLOCK])
    else:
        joined = df.select(*keys, *columns).join(brackets, keys)

    # Side of the bracket: values outside collapse to one row per side, values inside to one row per
    # distinct value, both on the map side.
    def placed(i: int):
        name, c, _ = specs[i]
        same = [n for n, col, _ in specs if col == c]
        at = same.index(name)
        lo, hi = F.col(f"_cut_{c}")[at], F.col(f"_cut_{c}")[at + len(same)]
        x = F.col(c).cast("double")
        side = F.when(x < lo, -1).when(x > hi, 1).otherwise(0)
        return F.struct(
            F.lit(i).alias("i"), F.col(f"_n_{c}").alias("n"), side.alias("side"),
            F.when((x >= lo) & (x <= hi), x).alias("v"), x.alias("x"),
        )

    counted = (
        joined.select(*keys, F.explode(F.array(*[placed(i) for i in range(len(specs))])).alias("_p"))
        .where(F.col("_p.x").isNotNull())
        .groupBy(*keys, *[F.col(f"_p.{f}").alias(f"_{f}") for f in ("n", "i", "side", "v")])
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_p.x").alias("_min"), F.max("_p.x").alias("_max"))
    )
    ranked = running_counts(stage(counted, "bracket"), [*keys, "_i"], ["_side", "_v"], "_c", range_rows)
    p = F.element_at(F.array(*[F.lit(p) for _, _, p in specs]), F.col("_i") + 1)
    target = p * (F.col("_n") - 1)
    low, high = F.floor(target), F.ceil(target)

    def value_at(rank):
        # Rank r (from 0) lies in a counted row when _from <= r < _to.  Outside the bracket only the value next to it
        # is known, the largest below or the smallest above; any other rank there means that the bracket missed.
        edge = F.when(F.col("_side") == -1, rank == F.col("_to") - 1).when(F.col("_side") == 1, rank == F.col("_from")).otherwise(True)
        here = (F.col("_from") <= rank) & (rank < F.col("_to"))
        value = F.when(F.col("_side") == -1, F.col("_max")).otherwise(F.col("_min"))
        return F.max(F.when(here & edge, value)), F.max(here & ~edge)

    (a, no_a), (b, no_b) = value_at(low), value_at(high)
    picked = (
        ranked.groupBy(*keys, "_i")
        .agg(a.alias("_a"), b.alias("_b"), (no_a | no_b).alias("_missed"), F.max(target - low).alias("_share"))
        .select(*keys, "_i", "_missed", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("_q"))
    )
    return stage(picked, "quantiles")
