"""Block layout: ordered work on series of any length without one-task windows.

``Window.partitionBy(series_id)`` sends a whole series to one task.  When one
series holds a third of all rows that task never ends.  So ordered operators
work on blocks of ``BLOCK_ROWS`` consecutive positions instead:

* ``number_rows`` gives each row its position.  It counts rows per time block
  (map-side combined), adds up the counts, and ranks inside the block only.
* ``spread`` copies the last ``behind`` (first ``ahead``) rows of a block into
  its neighbours, so a bounded frame finds all its rows inside one block.
* ``accumulate`` (sums, last values) and ``neighbours`` have unbounded frames.
  They reduce each block to one row, scan those rows, and join the carry back
  on ``(series_id, block)``.

Numbering writes a registry of the blocks once (``register_blocks``): lengths,
ends and block numbers of series come from there, not from another read of rows.

The scan over block rows is the only step keyed by series alone, and its input
is the data divided by ``BLOCK_ROWS``: 10^12 rows in one series leave 1.5*10^7
narrow rows, which a running frame streams (and spills) in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.plans.staging import stage

KEY = "series_id"
TS = "ts"
POS = "pos"
BLOCK = "_block"
TIME_BLOCK = "_tb"
BLOCK_ROWS = 65_536
UNFOLD = 4096  # entries of an array of block numbers


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, in any session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.unix_date(F.to_date(c)).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def from_epoch(seconds: Column) -> Column:
    """Inverse of ``epoch_seconds``."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def block_of(pos: Column | str = POS, block_rows: int = BLOCK_ROWS) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor((c - 1) / F.lit(block_rows)).cast("bigint")


def with_block(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(BLOCK, block_of(POS, block_rows))


# --------------------------------------------------------------- positions


def _rank_rows(df: DataFrame, offsets: DataFrame, name: str, order: str) -> DataFrame:
    inside = Window.partitionBy(KEY, name).orderBy(order)
    return (
        df.join(offsets.select(KEY, name, "offset"), [KEY, name])
        .withColumn(POS, (F.col("offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("offset", name)
    )


def _offsets(tagged: DataFrame, name: str, *more: Column) -> DataFrame:
    """One row a block: how many rows of the series lie before it, and how many it has."""
    earlier = Window.partitionBy(KEY).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(KEY, name).agg(F.count(F.lit(1)).alias("rows"), *more)
    return counts.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def _time_block(step_seconds: int, block_rows: int) -> Column:
    return F.floor(epoch_seconds(TS) / F.lit(step_seconds * block_rows)).cast("bigint")


def register_blocks(df: DataFrame, step_seconds: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The staged registry of a table that is to be numbered, one row for each time block of a series: ``offset``, ``rows``,
    ``first_ts``, ``last_ts``, and of the series ``n``, ``series_first_ts``, ``series_last_ts``."""
    tagged = df.select(KEY, TS, _time_block(step_seconds, block_rows).alias(TIME_BLOCK))
    blocks = _offsets(tagged, TIME_BLOCK, F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
    whole = Window.partitionBy(KEY)
    series = {"n": F.sum("rows"), "series_first_ts": F.min("first_ts"), "series_last_ts": F.max("last_ts")}
    return stage(blocks.withColumns({name: value.over(whole) for name, value in series.items()}), "registry")


def registered_blocks(registry: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(series_id, block, n)`` of the blocks of positions: a time block reaches into two of them at most."""
    ends = F.array_distinct(F.array(*[block_of(F.col("offset") + c, block_rows) for c in (F.lit(1), F.col("rows"))]))
    return registry.select(KEY, "n", F.explode(ends).alias(BLOCK)).distinct()


def number_rows(
    df: DataFrame, step_seconds: int, block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None
) -> DataFrame:
    """Add ``pos``.  ``ts`` is unique in a series and rows are ``step_seconds`` or more apart,
    so a time block of ``step_seconds * block_rows`` never exceeds ``block_rows`` rows.
    With a ``registry`` of ``df`` the rows are read once."""
    tagged = df.withColumn(TIME_BLOCK, _time_block(step_seconds, block_rows))
    return _rank_rows(tagged, _offsets(tagged, TIME_BLOCK) if registry is None else registry, TIME_BLOCK, TS)


def renumber(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Close the holes that a filter left in ``pos``."""
    old = df.withColumnRenamed(POS, "_old").withColumn(BLOCK, block_of("_old", block_rows))
    return _rank_rows(old, _offsets(old, BLOCK), BLOCK, "_old").drop("_old")


def renumber_sized(df: DataFrame, sums: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``renumber`` with the length ``n`` of each series and sums ``{new column: column}`` over it: the pass that counts the rows
    of blocks also sums them up."""
    old = df.withColumnRenamed(POS, "_old").withColumn(BLOCK, block_of("_old", block_rows))
    blocks = _offsets(old, BLOCK, *[F.sum(c).alias(f"_s_{out}") for out, c in sums.items()])
    whole = Window.partitionBy(KEY)  # block rows
    totals = {"n": F.sum("rows").over(whole)} | {out: F.sum(f"_s_{out}").over(whole) for out in sums}
    blocks = blocks.withColumns(totals).select(KEY, BLOCK, "offset", *totals)
    inside = Window.partitionBy(KEY, BLOCK).orderBy("_old")
    rows = old.join(blocks, [KEY, BLOCK]).withColumn(POS, (F.col("offset") + F.row_number().over(inside)).cast("bigint"))
    return rows.drop("offset", BLOCK, "_old")


# ------------------------------------------------------------ bounded frames


def spread(df: DataFrame, behind: int = 0, ahead: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Place each row in its own block and in every block whose frames reach it.

    The explicit shuffle by ``(series_id, block)`` also serves windows over parts of a block.
    """
    first = F.greatest(block_of(F.col(POS) - ahead, block_rows), F.lit(0).cast("bigint"))
    last = block_of(F.col(POS) + behind, block_rows)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).repartition(KEY, BLOCK)


def own_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Undo ``spread``: keep each row once, in its own block."""
    return df.where(F.col(BLOCK) == block_of(POS, block_rows)).drop(BLOCK)


def ordered() -> WindowSpec:
    """Rows of one block in series order (for lag and lead)."""
    return Window.partitionBy(KEY, BLOCK).orderBy(POS)


def trailing(n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return ordered().rowsBetween(-(n - 1), 0)


def over_blocks(df: DataFrame, add, behind: int = 0, ahead: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``add`` (a function that adds frame columns) on the spread table: one shuffle."""
    return own_rows(add(spread(df, behind, ahead, block_rows)), block_rows)


# ---------------------------------------------------------- unbounded frames


def _before() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    # Backwards from the end: a frame to unbounded following is recomputed for every row.
    return Window.partitionBy(KEY).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)


def _up_to_here() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def accumulate(
    df: DataFrame, totals: dict[str, str], fills: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cumulative sums ``{new column: summed column}`` (nulls count as 0) and last observations
    carried forward, with one pass for the block ends and one for the rows."""
    tagged = with_block(df, block_rows)
    ends = tagged.groupBy(KEY, BLOCK).agg(
        *[F.sum(c).alias(f"_s_{out}") for out, c in totals.items()],
        *[F.expr(f"max_by(`{c}`, {POS}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_t_{c}") for c in fills],
    )
    carry = ends.select(
        KEY,
        BLOCK,
        *[F.coalesce(F.sum(f"_s_{o}").over(_before()), F.lit(0)).alias(f"_c_{o}") for o in totals],
        *[F.last(f"_t_{c}", True).over(_before()).alias(f"_p_{c}") for c in fills],
    )
    here = _up_to_here()
    sums = {o: F.col(f"_c_{o}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for o, c in totals.items()}
    filled = {c: F.coalesce(F.last(c, True).over(here), F.col(f"_p_{c}")) for c in fills}
    return (
        tagged.join(carry, [KEY, BLOCK])
        .withColumns(sums | filled)
        .drop(BLOCK, *[f"_c_{o}" for o in totals], *[f"_p_{c}" for c in fills])
    )


def running_total(df: DataFrame, totals: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    return accumulate(df, totals, [], block_rows)


def fill_forward(df: DataFrame, cols: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    return accumulate(df, {}, cols, block_rows)


def neighbours(df: DataFrame, cols: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest non-null values.  For each column ``c`` add the position ``_pp_c`` and value
    ``_pv_c`` of the last one at or before the row, ``_np_c`` and ``_nv_c`` of the next one."""
    marks = {f"_at_{c}": F.when(F.col(c).isNotNull(), F.col(POS)) for c in cols}
    tagged = with_block(df, block_rows).withColumns(marks)
    ends = tagged.groupBy(KEY, BLOCK).agg(
        *[F.max(m).alias(f"_pp{m}") for m in marks],
        *[F.min(m).alias(f"_np{m}") for m in marks],
        *[F.max_by(c, f"_at_{c}").alias(f"_pv_at_{c}") for c in cols],
        *[F.min_by(c, f"_at_{c}").alias(f"_nv_at_{c}") for c in cols],
    )
    carry = ends.select(
        KEY,
        BLOCK,
        *[F.last(f"{k}{m}", True).over(_before()).alias(f"{k}{m}") for m in marks for k in ("_pp", "_pv")],
        *[F.last(f"{k}{m}", True).over(_after()).alias(f"{k}{m}") for m in marks for k in ("_np", "_nv")],
    )
    here = _up_to_here()
    backwards = Window.partitionBy(KEY, BLOCK).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    found = {}
    for c in cols:
        for side, frame in (("p", here), ("n", backwards)):
            for kind, source in (("p", f"_at_{c}"), ("v", c)):
                near = F.last(source, True).over(frame)
                found[f"_{side}{kind}_{c}"] = F.coalesce(near, F.col(f"_{side}{kind}_at_{c}"))
    spare = [f"_{k}_at_{c}" for c in cols for k in ("pp", "pv", "np", "nv")]
    return tagged.join(carry, [KEY, BLOCK]).withColumns(found).drop(BLOCK, *marks, *spare)


# ------------------------------------------------------------- series values


def block_numbers(last: Column | str, block_rows: int = BLOCK_ROWS) -> tuple[Column, Column]:
    """Two explodes that number the blocks up to position ``last``: the first gives ``_chunk``, the second the block.
    No array has more than ``UNFOLD`` entries unless a series has more than ``UNFOLD ** 2`` blocks."""
    end = block_of(last, block_rows)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), end, F.lit(UNFOLD).cast("bigint")))
    return chunk, F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + UNFOLD - 1, end)))


def by_block(per_series: DataFrame, last: str = "n", block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None) -> DataFrame:
    """One row per series to one for each of its blocks, from the registry or up to the position in column ``last``."""
    if registry is not None:
        return per_series.join(registered_blocks(registry, block_rows).select(KEY, BLOCK), KEY)
    chunk, block = block_numbers(last, block_rows)
    return per_series.withColumn("_chunk", chunk).withColumn(BLOCK, block).drop("_chunk")


def attach_series(
    df: DataFrame, per_series: DataFrame, last: str = "n", block_rows: int = BLOCK_ROWS, registry: DataFrame | None = None
) -> DataFrame:
    """Join one row per series to its series without shuffling a hot series to one task.

    Its row is repeated once per block, and the join key is ``(series_id, block)``.  The blocks are those of a ``registry``
    of the table, else ``per_series`` carries the highest position in column ``last``.
    """
    copies = by_block(per_series, last, block_rows, registry)
    return with_block(df, block_rows).join(copies, [KEY, BLOCK]).drop(BLOCK)


def series_length(df: DataFrame, *extra: Column) -> DataFrame:
    """``n`` (highest position) per series, plus further aggregates of the same pass."""
    return df.groupBy(KEY).agg(F.max(POS).alias("n"), *extra)
