"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents, in a shuffled order, lie end to end on a line of tokens that is cut into blocks of equal token
count.  Slot ``n`` of the mix draws the point ``frac(n * golden ratio)``; the cumulative weights tell its source; its rank
among the slots of that source tells the block, round after round.  Any stretch of the mix therefore holds each source
close to its share, and a rerun gives the same mix.

Scale: lines, ranks and rounds are prefix sums in two levels (within chunks, then over one row per chunk and source), so
no window spans a source; slots join blocks on ``(source, block)``, of which even the largest source has many.

Defined results: a null text has size 0, as has a text without words, and is in no block; a null source is a source of its
own and sorts last; equal rows stay separate rows; without any word every target is 0; other columns pass through
``mixed_documents`` unless they begin with ``_mix``, and are not read by ``mixture_report``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.steps import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)  # by source in code point order, repeating
MOST = 3  # times a source may be seen
BLOCK = 1024  # tokens
CHUNK_SHIFT = 14  # documents or slots of a chunk, as a power of two
GOLDEN = 0.6180339887498949


def word_count(text: str | Column = "text", pattern: str = WORD) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``, one row a source.

    Targets share the whole by weight; none exceeds ``most`` times its size.  With sources ordered by the ratio of cap to
    weight, the capped ones come first, so one pass over the sources finds the level at which the rest share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = sizes.withColumn("weight", F.element_at(table, (turn + 1).cast("int")))
    out = out.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / F.sum("weight").over(rest))
    place = F.when(F.col("_level") <= F.col("_ratio"), F.row_number().over(by_ratio))
    out = out.withColumn("_place", place).withColumn("_free", F.min_by("_level", "_place").over(everything))
    target = F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_free") * F.col("weight")))
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def _prefix(rows: DataFrame, by: list[str], chunk: str, order: list, value: str, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of ``chunk`` then ``order``, within ``by``."""
    return prefix_sums(rows, by, chunk, order, {name: value})


def prefix_sums(rows: DataFrame, by: list[str], chunk: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums ``{new column: column}`` in the order of ``chunk`` then ``order``, within ``by``, in one pass."""
    ends = rows.groupBy(*by, chunk).agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()])
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carries = [F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_carry_{name}") for name in sums]
    carry = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(chunk).alias("_chunk_of"), *carries)
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(carry[f"_by_{c}"]) for c in by], rows[chunk] == carry["_chunk_of"])
    inside = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, same).drop("_chunk_of", *[f"_by_{c}" for c in by])
    joined = joined.withColumns({n: F.col(f"_carry_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()})
    return joined.drop(*[f"_carry_{name}" for name in sums])


def token_lines(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with at least one word, with ``_mix_size`` and their place ``_mix_start`` on the source's line."""
    chunks = max(1, docs.count() >> CHUNK_SHIFT)
    key = F.xxhash64(F.col("doc_id"), F.lit("mix"))
    rows = docs.where("_mix_size > 0").withColumn("_mix_key", key).withColumn("_mix_chunk", F.pmod(key, F.lit(chunks)))
    return _prefix(rows, ["source"], "_mix_chunk", ["_mix_key", "doc_id", "_mix_row"], "_mix_size", "_mix_start").drop("_mix_key", "_mix_chunk")


def block_plan(targets: DataFrame, most: int = MOST, largest: int = BLOCK, smallest: int = 16) -> DataFrame:
    """``targets`` with ``blocks`` (equal blocks of the source's line, to a token) and ``slots`` (its ideal share).

    A block has a 4096th of the source's target, ``smallest`` to ``largest`` tokens, so that a slot more or less does not
    tell and the number of slots stays far below the number of tokens.
    """
    tokens = F.greatest(F.lit(smallest), F.least(F.lit(largest), F.ceil(F.col("target") / 4096)))
    out = targets.where("source_size > 0 AND target > 0").withColumn("blocks", F.ceil(F.col("source_size") / tokens))
    return out.withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))


def schedule(plan: DataFrame, most: int = MOST) -> DataFrame:
    """The slots of the mix: ``(slot, source, rank, block, round)``.

    ``rank`` counts the source's slots, ``block`` is the block on its line and ``round`` how often it came before.  A slot
    of a source that has been seen ``most`` times is left out.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cuts = plan.withColumn("_high", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = written(cuts.withColumn("_low", F.coalesce(F.lag("_high").over(order), F.lit(0.0))), "cuts")
    sources, whole = cuts.agg(F.count("*"), F.coalesce(F.max("_high"), F.lit(1.0))).first()  # two numbers
    cells = 1024 << max(0, (4 * sources // 1024).bit_length())
    cell = lambda at: F.floor(at * (cells / whole))
    cuts = cuts.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    slots = plan.sparkSession.range(round(whole) if sources else 0).withColumnRenamed("id", "slot")
    point = F.col("slot") * F.lit(GOLDEN)
    slots = slots.withColumn("_at", (point - F.floor(point)) * F.lit(float(whole))).withColumn("_cell", cell(F.col("_at")))
    placed = slots.join(cuts, "_cell").where("_low <= _at AND _at < _high").select("slot", "source", "blocks", F.lit(1).alias("_one"))
    placed = placed.withColumn("_mix_chunk", F.shiftright("slot", CHUNK_SHIFT))
    ranked = _prefix(written(placed, "slots"), ["source"], "_mix_chunk", ["slot"], "_one", "rank")
    ranked = ranked.withColumn("block", F.pmod("rank", "blocks")).withColumn("round", F.floor(F.col("rank") / F.col("blocks")))
    return ranked.where(F.col("round") < most).select("slot", "source", "rank", "block", "round")


def pieces(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """``lines`` cut at block borders: ``block``, ``_mix_from`` (first word within the document) and ``_mix_words``."""
    of = plan.select(F.col("source").alias("_of"), F.col("source_size").alias("_line"), "blocks")
    rows = lines.join(of, lines.source.eqNullSafe(of._of)).drop("_of")
    border = lambda b: F.expr(f"({b}) * _line div blocks")  # noqa: E731  word at which block b begins
    at = lambda w: F.expr(f"(({w}) * blocks + blocks - 1) div _line")  # noqa: E731  block of a word, or the one behind it
    low, high = at("_mix_start"), at("_mix_start + _mix_size - 1")
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), low - 1), F.least(high, F.col("blocks") - 1))))
    begin = F.greatest(border("block"), F.col("_mix_start"))
    end = F.least(border("block + 1"), F.col("_mix_start") + F.col("_mix_size"))
    rows = rows.withColumn("_mix_from", begin - F.col("_mix_start")).withColumn("_mix_words", end - begin)
    return rows.where("_mix_words > 0").drop("_line", "blocks")


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered sizes of the rows (``doc_id``, ``source``, ``_mix_size``, ``_mix_row``), and the sources' targets."""
    rows = docs.select("doc_id", "source", word_count().alias("_mix_size"), F.monotonically_increasing_id().alias("_mix_row"))
    rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    return rows, written(source_targets(sizes), "targets")


def mixed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix itself: ``slot``, ``round``, and the document's piece that fills (a part of) it."""
    plan = written(block_plan(targets), "plan")
    cut = pieces(token_lines(rows), plan)
    slots = schedule(plan)
    slots = slots.select("slot", F.col("source").alias("_of"), F.col("block").alias("_block"), "round")
    same = cut.source.eqNullSafe(slots._of) & (cut.block == slots._block)
    return cut.join(slots, same).drop("_of", "_block")


def mixture_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken``."""
    rows, targets = prepared(docs)
    taken = mixed(rows, targets).groupBy(F.col("_mix_row").alias("_row")).agg(F.sum("_mix_words").alias("taken"))
    of = targets.select(F.col("source").alias("_of"), "source_size", "target")
    out = rows.join(of, rows.source.eqNullSafe(of._of)).join(taken, F.col("_mix_row") == F.col("_row"), "left")
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return out.select("doc_id", "source", F.col("_mix_size").alias("size"), "source_size", "target", taken)
