"""Trie of conversations by common prefixes, from fingerprints that compose.

A turn is its role and text, known by SHA-256.  A sequence's fingerprint is its polynomial in ``ROOT`` modulo the prime
``2**127 - 1``; fingerprints of (length, value) are a monoid: ``(n, x)(m, y) = (n + m, x * ROOT**m + y)``.  Prefix products of the
given conversations are computed once.  A rebuilt conversation is a head of its base and a tail of its own; the fingerprint of
each of its prefixes follows from two such products, so no rebuilt text or turn list is ever made.  Equal fingerprints at equal
depth are a node; its members must agree in the reference (SHA-256) of their last turn and in their parent, else the job stops:
by induction over depth the members' prefixes then are the same.

Subtrees need no walk from level to level.  A node belongs to its smallest member, and the nodes of one member are the lower end
of its path.  Leaves and savings are summed per member over the nodes it owns, and a node adds up its members' sums, without what
its owner owns above it.

Skew: turns are placed by ranges, long conversations are joined by blocks of ``BLOCK_ROWS`` turns, groups combine before the
shuffle, and ids that end in one node are joined to pieces of ``PIECE`` bytes in many tasks before one hash reads the pieces.

Defined results: null role or text is empty; turns of one number are ordered by SHA-256 of role and text, null turns first, equal
rows are separate turns; rows without ``conv_id`` are left out; the remainder of a negative id has its sign, as in SQL; a
conversation without rebuilt turns is a member of the root only; a table without conversations has no root; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.ordered_runs import Product, ordered_runs
from barloom.llm.steps import discard, per_batch, written
from barloom.plans.blocks import BLOCK_ROWS, KEY, POS, running_total
from barloom.plans.staging import ship_package

PRIME = (1 << 127) - 1
ROOT = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
_BACK = pow(ROOT, -1, PRIME)
EMPTY = bytes(16)
GROUP, HEADS = 5, 9  # a base serves so many ids; a head has fewer turns than this
PIECE = 1 << 20
_PATH = "conv long, depth long, f1 long, f2 long, p1 long, p2 long, t1 long, t2 long, size long, length long"
_NODE = ["depth", "f1", "f2"]


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _element(reference: bytes) -> int:
    return _number(reference[:16]) % PRIME


def combine(before: bytes, rows: int, after: bytes) -> bytes:
    """The fingerprint of a sequence followed by ``rows`` more turns with fingerprint ``after``."""
    return ((_number(before) * pow(ROOT, rows, PRIME) + _number(after)) % PRIME).to_bytes(16, "big")


def extended(base: bytes, skipped: bytes, rows: int, whole: bytes) -> int:
    """Fingerprint of ``base`` followed by what ``whole`` has after its beginning ``skipped``, which is ``rows`` turns."""
    return ((_number(base) - _number(skipped)) * pow(ROOT, rows, PRIME) + _number(whole)) % PRIME


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, pos, mark, ref, size)``: turns in order, with the fingerprint of the conversation up to each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ref = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", ref.alias("ref"), F.octet_length(text).cast("long").alias("size")
    )
    product = Product("ref", lambda r: _element(r).to_bytes(16, "big"), EMPTY, combine)
    return written(ordered_runs(turns, "conv", ["turn", "ref"], "turns", product).drop("turn"), "placed")


def rebuilt(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """One row a conversation: ``conv``, ``n`` turns, ``h``, the base's turns ``front`` that it begins with, and ``skipped``, the
    fingerprint of its own turns that these replace."""
    few = F.when(F.col(POS) < HEADS, F.struct(POS, "mark", "ref", "size"))
    convs = turns.groupBy("conv").agg(F.max(POS).alias("n"), F.array_sort(F.collect_list(few)).alias("own"))
    convs = written(convs.withColumn("h", head).withColumn("base", base), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("front"))
    front = F.slice(F.coalesce("front", F.array().cast(convs.schema["own"].dataType)), F.lit(1), F.col("h"))
    skipped = F.coalesce(F.get(F.col("own.mark"), F.col("h") - 1), F.lit(EMPTY))
    return written(convs.join(bases, "base", "left").select("conv", "n", "h", front.alias("front"), skipped.alias("skipped")), "rebuilt")


def _halves(values: list[int]) -> tuple[list[int], list[int]]:
    """Numbers below 2**127 as pairs of signed 64-bit ones."""
    mask, half = (1 << 64) - 1, 1 << 63
    return [v >> 64 for v in values], [(v & mask) - half for v in values]


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    """``rows``: conversation, depth, fingerprint, parent's, reference, size, length."""
    conv, depth, prints, parents, refs, sizes, lengths = zip(*rows, strict=True) if rows else ([],) * 7
    f1, f2 = _halves(prints)
    p1, p2 = _halves(parents)
    t1, t2 = _halves([_number(r[16:]) >> 1 for r in refs])  # the half that the fingerprint has not
    names = [field.split()[0] for field in _PATH.split(", ")]
    return pa.record_batch([pa.array(v, pa.int64()) for v in (conv, depth, f1, f2, p1, p2, t1, t2, sizes, lengths)], names)


def _front_rows(rebuilt_: DataFrame) -> DataFrame:
    """The root and the prefixes within the base's turns."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, n, h, front in zip(*(batch.column(c).to_pylist() for c in ("conv", "n", "h", "front")), strict=True):
            length, before = len(front) + max(n - h, 0), 0
            rows.append((conv, 0, 0, 0, EMPTY, 0, length))
            for depth, turn in enumerate(front, 1):
                mark = _number(turn["mark"])
                rows.append((conv, depth, mark, before, turn["ref"], turn["size"], length))
                before = mark
        yield _path_batch(rows)

    return per_batch(rebuilt_.select("conv", "n", "h", "front"), work, _PATH)


def _tail_rows(turns: DataFrame, rebuilt_: DataFrame) -> DataFrame:
    """The prefixes that end in a conversation's own turns."""
    last = F.element_at(F.col("front.mark"), -1)
    heads = rebuilt_.where("n > h").select(
        "conv", "n", "h", F.size("front").cast("long").alias("f"), F.when(F.size("front") > 0, last).otherwise(F.lit(EMPTY)).alias("start"), "skipped",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK_ROWS}"))).alias("_block"),
    )
    both = turns.withColumn("_block", F.expr(f"{POS} div {BLOCK_ROWS}")).join(heads, ["conv", "_block"]).where(F.col(POS) > F.col("h"))
    columns = ["conv", POS, "mark", "ref", "size", "n", "h", "f", "start", "skipped"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, pos, mark, ref, size, n, h, f, start, skipped in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            value = extended(start, skipped, pos - h, mark)
            rows.append((conv, f + pos - h, value, (value - _element(ref)) * _BACK % PRIME, ref, size, f + n - h))
        yield _path_batch(rows)

    return per_batch(both.select(columns), work, _PATH)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, f1, f2, ends_sha256)`` of the nodes in which several conversations end: ``ends`` has a row for each."""
    names = [*_NODE, "first", "ids"]

    def pieces(batches):
        node, first, ids, size = None, None, [], 0

        def piece():
            return pa.record_batch([pa.array([v]) for v in (*node, first, ",".join(ids))], names)

        for batch in batches:
            for *here, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv")), strict=True):
                if here != node or size > PIECE:
                    if ids:
                        yield piece()
                    node, first, ids, size = here, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashes(batches):
        node, digest = None, None
        names = [*_NODE, "ends_sha256"]
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
                if here == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.record_batch([pa.array(v) for v in zip(*done, strict=True)], names)
        if node:
            yield pa.record_batch([pa.array([v]) for v in (*node, digest.hexdigest())], names)

    key = "depth long, f1 long, f2 long"
    dealt = ends.select(*_NODE, "conv").repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    parts = written(dealt.mapInArrow(pieces, f"{key}, first long, ids string"), "pieces")
    return parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashes, f"{key}, ends_sha256 string")


def crc32(c: str) -> Column:
    """Unsigned CRC-32 of the decimal text of an integer."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """All nodes: ``depth``, fingerprint ``(f1, f2)`` and the parent's ``(p1, p2)``, ``conv_id`` (smallest member), ``parent_conv_id``,
    ``n_convs``, ``n_ends``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``base`` and ``head``, expressions of ``conv``, say from which conversation the first ``head`` turns (at most ``HEADS - 1``) come.
    """
    ship_package(conversations.sparkSession)
    base = F.col("conv") - F.col("conv") % GROUP if base is None else base
    head = crc32("conv") % HEADS if head is None else head
    turns = placed_turns(conversations)
    convs = rebuilt(turns, base, head.cast("int"))
    paths = written(_front_rows(convs).union(_tail_rows(turns, convs)), "paths")
    discard(turns, convs)
    ends = F.col("depth") == F.col("length")
    counts = [
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
        F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("conv"))).alias("ender"),
    ]
    same = [(F.min(c).alias(f"low_{c}"), F.max(c).alias(c)) for c in ("p1", "p2", "t1", "t2")]
    nodes = paths.groupBy(*_NODE).agg(*counts, *[a for pair in same for a in pair])
    differ = " OR ".join(f"low_{c} <> {c}" for c in ("p1", "p2", "t1", "t2"))
    unequal = F.raise_error(F.lit("different prefixes with one fingerprint")).cast("long")
    nodes = written(nodes.withColumn("n_convs", F.when(F.expr(differ), unequal).otherwise(F.col("n_convs"))), "nodes")
    value = (F.col("n_convs") - 1) * F.col("size")
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("top"), F.sum(value).alias("saved"), F.max(F.when(F.col("n_convs") == F.col("n_ends"), 1).otherwise(0)).alias("leaf"), F.max("depth").alias("low")
    )
    block = F.expr(f"depth div {BLOCK_ROWS}")
    copies = owned.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"low div {BLOCK_ROWS}")))).drop("low")
    both = paths.withColumn("_block", block).join(copies, ["conv", "_block"], "left")
    child = (F.col("top") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    sums = both.groupBy(*_NODE).agg(
        F.count_if(child).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        F.sum(F.coalesce("saved", F.lit(0))).alias("_saved"), F.min("top").alias("_top"),
    )
    full = written(nodes.drop("low_p1", "low_p2", "low_t1", "low_t2", "t1", "t2").join(sums, _NODE), "sums")
    discard(nodes)
    # what the owner owns above the node is not below it
    above = running_total(full.withColumns({KEY: F.col("conv_id"), POS: F.col("depth") + 1, "_value": value}), {"_sum": "_value"}).drop(KEY, POS)
    full = written(above.withColumn("saved_tokens", F.col("_saved") - F.col("_sum") + F.col("_value")).drop("_sum", "_saved"), "full")
    owns = full.where("_top < depth").withColumn("parent_conv_id", F.col("conv_id"))
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    parents = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tops = full.where("_top = depth AND depth > 0").join(parents, ["depth", "p1", "p2"]).select(owns.columns)
    several = full.where("n_ends > 1").select(*_NODE)
    hashed = _end_hashes(paths.where(ends).join(several, _NODE, "left_semi"))
    every = owns.union(tops).union(root).join(hashed, _NODE, "left")
    one = F.sha2(F.coalesce(F.col("ender").cast("string"), F.lit("")).cast("binary"), 256)
    every = every.withColumn("ends_sha256", F.coalesce("ends_sha256", one))
    names = "depth f1 f2 p1 p2 conv_id parent_conv_id n_convs n_ends n_children n_leaves saved_tokens ends_sha256"
    return every.select(*names.split())


def report(conversations: DataFrame) -> DataFrame:
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"
    return prefix_trie(conversations).select(*names.split())
