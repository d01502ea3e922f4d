"""Merkle manifest of a dataset: one tree a group, stored as blocks in van Emde Boas layout, with proofs for every row.

Leaves are SHA-256 digests of rows.  ``FAN`` consecutive nodes become one, until one is left.  The tree is kept in blocks of
``LEVELS`` levels: a block is an aligned subtree of at most ``FAN ** LEVELS`` leaves, one row of the manifest, its digests in one
array laid out by ``addresses``: the subtree is split at half height, its top part comes first, then its bottom parts, each laid
out the same way.  The roots of a tier's blocks are the leaves of the next tier; the roots of groups are the leaves of the top
tree.  Construction and the search for siblings both go by those addresses.

Skew: rows are placed by ranges (see ``ordered_runs``), a group of any size is many blocks, a task holds one block.  A proof
goes down from tier to tier: each tier has as many proofs as it has blocks below, the last one a proof for each row.

Defined results: null values are ``-`` in a leaf; rows of a null group are a group of their own, which comes first; rows with the
same order column are ordered by leaf, null first, equal rows are separate leaves; a group of one row has its leaf as root; a
table without rows has no root and no proofs; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.ordered_runs import ordered_runs
from barloom.llm.steps import per_batch, written
from barloom.plans.staging import ship_package

FAN = 8
LEVELS = 4  # a block has up to 4,096 leaves
TAMPERED = 3  # one row in so many
_BLOCK = "grp string, block long, leaves int, levels int, nodes binary, root binary"
_PATH = "array<struct<place:int,others:binary>>"
_PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))


class Manifest(NamedTuple):
    leaves: DataFrame  # the rows with grp, idx, leaf
    tiers: list[DataFrame]  # blocks of the groups' trees, lowest first
    top: list[DataFrame]  # blocks of the tree over the groups' roots
    sizes: list[DataFrame]  # (grp, n) of each tier
    groups: DataFrame  # (grp, idx, subroot)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the values one after the other, each with its length in bytes before it."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@lru_cache(maxsize=None)
def addresses(levels: int, fan: int = FAN) -> tuple[np.ndarray, ...]:
    """Place of every node of a complete tree of ``levels`` levels: one array for each depth, the root's first."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    top = levels // 2
    bottom = levels - top
    upper, lower = addresses(top, fan), addresses(bottom, fan)
    before, each = sum(len(a) for a in upper), sum(len(a) for a in lower)
    start = before + each * np.arange(fan**top, dtype=np.int64)
    return upper + tuple((start[:, None] + a[None, :]).ravel() for a in lower)


def height(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while fan**h < n:
        h += 1
    return h


def build_block(leaves: list[bytes], levels: int, fan: int = FAN) -> bytes:
    """The digests of an aligned subtree, each at its address; places without a node are zero."""
    at = addresses(levels + 1, fan)
    rows = [leaves]
    for _ in range(levels):
        texts = [d.hex() for d in rows[-1]]
        rows.append([hashlib.sha256("".join(texts[i : i + fan]).encode()).digest() for i in range(0, len(texts), fan)])
    used = max(int(at[levels - k][len(r) - 1]) for k, r in enumerate(rows)) + 1
    out = np.zeros((used, 32), dtype=np.uint8)
    for k, r in enumerate(rows):
        out[at[levels - k][: len(r)]] = np.frombuffer(b"".join(r), dtype=np.uint8).reshape(-1, 32)
    return out.tobytes()


def block_paths(nodes: bytes, leaves: int, levels: int, fan: int = FAN) -> list[list[tuple[int, bytes]]]:
    """For each leaf of a block its siblings level by level, lowest first: own place in the run, the others' digests."""
    at, body = addresses(levels + 1, fan), np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32)
    paths: list[list[tuple[int, bytes]]] = [[]]  # of the root
    width = [leaves]
    for _ in range(levels):
        width.append(-(-width[-1] // fan))
    for depth in range(1, levels + 1):
        n, below = width[levels - depth], []
        for run in range(0, n, fan):
            digests = [body[a].tobytes() for a in at[depth][run : min(run + fan, n)]]
            for place in range(len(digests)):
                below.append([(place, b"".join(digests[:place] + digests[place + 1 :])), *paths[run // fan]])
        paths = below
    return paths


def _tier(nodes: DataFrame, sizes: DataFrame, name: str, fan: int, levels: int) -> DataFrame:
    """The blocks over ``nodes`` ``(grp, idx, digest)``; ``sizes``: ``(grp, n)``."""
    span = fan**levels

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(left.column("idx")))
        digests = left.column("digest").take(pa.array(order)).to_pylist()
        high = min(levels, height(right.column("n")[0].as_py(), fan))
        body = build_block(digests, high, fan)
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "leaves": pa.array([len(digests)], pa.int32()), "levels": pa.array([high], pa.int32()), "nodes": [body], "root": [body[:32]]})

    blocks = sizes.select("grp", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {span}"))).alias("block"))
    left = nodes.select("grp", F.expr(f"idx div {span}").alias("block"), "idx", "digest").groupBy("grp", "block")
    return written(left.cogroup(blocks.groupBy("grp", "block")).applyInArrow(work, _BLOCK), name)


def _grow(nodes: DataFrame, sizes: DataFrame, name: str, fan: int, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All tiers of the trees over ``nodes``, lowest first, and the sizes of each; a tree ends where it is one block."""
    tiers, steps, span = [], [], fan**levels
    while True:
        tiers.append(_tier(nodes, sizes, name, fan, levels))
        steps.append(sizes)
        if (sizes.agg(F.max("n")).first()[0] or 0) <= span:  # one number
            return tiers, steps
        nodes = tiers[-1].select("grp", F.col("block").alias("idx"), F.col("root").alias("digest"))
        sizes = written(sizes.where(F.col("n") > span).select("grp", F.expr(f"(n + {span - 1}) div {span}").alias("n")), "sizes")
        nodes = nodes.join(sizes.select("grp"), "grp", "left_semi")


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, carried: dict[str, Column], fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The trees over ``rows``; ``carried`` columns stay with the leaves."""
    ship_package(rows.sparkSession)
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # the null group sorts first
    placed = rows.select(named.alias("grp"), F.col(order).alias("_order"), leaf.alias("digest"), *[c.alias(n) for n, c in carried.items()])
    leaves = ordered_runs(placed, "grp", ["_order", "digest"], "leaves").withColumn("idx", F.col("pos") - 1).drop("pos")
    sizes = written(leaves.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    tiers, steps = _grow(leaves, sizes, "blocks", fan, levels)
    span = fan**levels
    done = None
    for blocks, of in zip(tiers, steps, strict=True):
        roots = blocks.join(of.where(F.col("n") <= span).select("grp"), "grp", "left_semi").select("grp", "root")
        done = roots if done is None else done.union(roots)
    groups = ordered_runs(done.select(F.lit("").alias("all"), "grp", "root"), "all", ["grp"], "groups")
    groups = groups.select("grp", (F.col("pos") - 1).alias("idx"), F.col("root").alias("subroot"))
    nodes = groups.select(F.lit("").alias("grp"), "idx", F.col("subroot").alias("digest"))
    top, _ = _grow(nodes, written(nodes.groupBy("grp").agg(F.count("*").alias("n")), "sizes"), "top-blocks", fan, levels)
    return Manifest(leaves, tiers, top, steps, groups)


def _descend(blocks: DataFrame, paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """Paths ``(grp, idx, path)`` of every leaf of ``blocks``; ``paths``: those of the blocks' roots, none for a tree's last block."""
    above = paths.select("grp", F.col("idx").alias("block"), F.col("path").alias("above"))
    span = fan**levels

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for grp, block, n, high, nodes, up in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            rest, start = [(s["place"], s["others"]) for s in up or []], block * span
            found = [[{"place": p, "others": o} for p, o in own + rest] for own in block_paths(nodes, n, high, fan)]
            yield pa.record_batch(
                {
                    "grp": [grp] * n,
                    "idx": pa.array(range(start, start + n), pa.int64()),
                    "path": pa.array(found, _PATH_TYPE),
                }
            )

    both = blocks.join(above, ["grp", "block"], "left").select("grp", "block", "leaves", "levels", "nodes", "above")
    return per_batch(both, work, f"grp string, idx long, path {_PATH}")


def root_paths(m: Manifest, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``(grp, subroot, path)``: the way from each group's root to the root of all."""
    spark = m.groups.sparkSession
    paths = spark.createDataFrame([], f"grp string, idx long, path {_PATH}")
    for blocks in reversed(m.top):
        paths = written(_descend(blocks, paths, fan, levels), "top-paths")
    found = paths.select("idx", "path")
    return m.groups.join(found, "idx").select("grp", "subroot", "path")


def _fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    for place, others in path:
        node = _h([*others[:place], node, *others[place:]])
    return node


def proofs(m: Manifest, carried: list[str], tampered: str, whole: bool = True, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """For each leaf: ``carried`` columns, ``leaf``, ``subroot``, ``root``, ``proof`` if ``whole`` (places and siblings from the leaf
    to the root), ``proof_sha256``, ``folded_root`` from the digest in column ``tampered``, and whether that is the ``root``."""
    span = fan**levels
    tops = written(root_paths(m, fan, levels), "root-paths")
    last = tops.select("grp", F.lit(0).cast("long").alias("idx"), "path")
    above = None
    for blocks, of in zip(reversed(m.tiers), reversed(m.sizes), strict=True):
        ends = last.join(of.where(F.col("n") <= span).select("grp"), "grp", "left_semi")
        above = ends if above is None else ends.unionByName(above)
        if blocks is not m.tiers[0]:
            above = written(_descend(blocks, above, fan, levels), "paths")
    root = m.top[-1].select(F.lit(0).alias("_all"), F.col("root").alias("all_root"))  # one row
    ready = m.tiers[0].select("grp", "block", "leaves", "levels", "nodes")
    ready = ready.join(above.select("grp", F.col("idx").alias("block"), "path"), ["grp", "block"])
    ready = ready.join(tops.select("grp", "subroot"), "grp").withColumn("_all", F.lit(0)).join(root, "_all").drop("_all")
    rows = m.leaves.select("grp", F.expr(f"idx div {span}").alias("block"), "idx", "digest", F.col(tampered).alias("_tampered"), *carried)
    types = ", ".join(f"`{c}` {m.leaves.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{types}, leaf string, subroot string, root string, {f'proof {_PATH}, ' if whole else ''}proof_sha256 string, folded_root string, verified boolean"

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(np.asarray(left.column("idx")))))
        block = right.to_pylist()[0]
        above = [(s["place"], s["others"]) for s in block["path"]]
        own = block_paths(block["nodes"], block["leaves"], block["levels"], fan)
        texts: dict[bytes, list[str]] = {}

        def split(others: bytes) -> list[str]:
            if others not in texts:
                texts[others] = [others[i : i + 32].hex() for i in range(0, len(others), 32)]
            return texts[others]

        root, n = block["all_root"].hex(), len(left)
        leaves, others = left.column("digest").to_pylist(), left.column("_tampered").to_pylist()
        ways = [[(p, split(o)) for p, o in path + above] for path in own]
        folded = [_fold(other.hex(), way) for other, way in zip(others, ways, strict=True)]
        out = {c: left.column(c) for c in carried}
        out |= {"leaf": [leaf.hex() for leaf in leaves], "subroot": [block["subroot"].hex()] * n, "root": [root] * n}
        if whole:
            out["proof"] = pa.array([[{"place": p, "others": o} for p, o in path + above] for path in own], _PATH_TYPE)
        out["proof_sha256"] = [_h([s for _, siblings in way for s in siblings]) for way in ways]
        return pa.table(out | {"folded_root": folded, "verified": [f == root for f in folded]})

    return rows.groupBy("grp", "block").cogroup(ready.groupBy("grp", "block")).applyInArrow(work, schema)


def crc32(c: str) -> Column:
    """Unsigned CRC-32 of the decimal text of an integer."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


def document_manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """One tree a language over the documents by id; ``tampered`` is the digest after the trial change: in one row of
    ``TAMPERED``, chosen by id, the text's A-Z become lower case."""
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(crc32("doc_id") % TAMPERED == 0, F.lit(False))
    docs = docs.withColumn("_other", F.when(changed, lowered).otherwise(F.col("text")))
    leaf, other = row_digest("doc_id", "source", "lang", "n_chars", "text"), row_digest("doc_id", "source", "lang", "n_chars", "_other")
    return manifest(docs, "lang", "doc_id", leaf, {"doc_id": F.col("doc_id"), "tampered": other}, fan, levels)


def report(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    found = proofs(document_manifest(docs, fan, levels), ["doc_id"], "tampered", False, fan, levels)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
