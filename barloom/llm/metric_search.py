"""Exact top-k search by inner product with M-trees.

Rows are dealt by hash to shards, each indexed by an M-tree: pages of at most ``PAGE`` entries, every entry with its distance to
the page's pivot, every page with a covering radius.  With one more coordinate ``sqrt(M * M - |x| * |x|)`` all vectors lie
on a sphere, where the largest inner product is the smallest distance, so the triangle inequality bounds scores from above.
A query opens pages from the best bound down and skips pages and entries whose bound, from stored distances alone, can't
reach its k-th score.  The few best of every shard meet in one ranking per query.

A shard has about ``SHARD_ROWS`` rows; queries come to it in chunks of about ``QUERY_CHUNK``, and a task holds one tree and one
chunk.  Of equal vectors in a shard only the ``k + 1`` smallest ids can be among the results, so a vector that a third of all
rows share costs nothing.  How much the bounds save depends on the vectors: nearly all where they cluster, nothing where they
are spread evenly in many dimensions; there the work is that of every query against every row.

Defined results: vectors that are null or have null or non-finite components, and rows without an id, take no part; of rows with
one id the vector that sorts first counts; a missing component of a shorter vector counts as 0; an empty vector scores 0;
components so large that an inner product may leave 64 bits are an error.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.steps import discard, written
from barloom.plans.staging import ship_package

SHARD_ROWS = 8192
PAGE = 256
FAN = 16  # children of an inner page
QUERY_CHUNK = 16_384
TASKS = 8192  # partitions of searches at most
SCALE = 1024


def quantised(table: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, components as ``floor(1024 * x)``."""
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(vec, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    rows = table.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & usable).select(F.col(key).alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


class MTree:
    """Pages are tuples: ``(pivot row, radius, children or None, rows, distances of rows or children to the pivot)``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        same = np.zeros(len(ids), dtype=bool)
        same[1:] = (x[1:] == x[:-1]).all(axis=1)
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
        keep = np.arange(len(ids)) - start <= k
        self.ids, self.x = ids[keep], x[keep]
        square = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(square.max()) if len(square) else 0.0
        self._lifted = np.column_stack([self.x.astype(np.float64), np.sqrt(np.maximum(self.top - square, 0))])
        self._plain = None  # the vectors as doubles, for products that doubles hold exactly
        self.pages: list[tuple] = []
        self._build(np.arange(len(self.ids)), 0)
        del self._lifted

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self._lifted[rows] - self._lifted[pivot]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, pivot: int) -> int:
        """Add the page of ``rows`` around ``pivot`` and everything below it; its number."""
        here = len(self.pages)
        self.pages.append(())
        far = self._distance(rows, pivot) if len(rows) else np.zeros(0)
        radius = float(far.max()) if len(far) else 0.0
        if len(rows) <= PAGE:
            self.pages[here] = (pivot, radius, None, rows, far)
            return here
        picks = [rows[int(far.argmax())]]  # far apart: each pivot is the farthest from those before
        nearest = self._distance(rows, picks[0])
        owner = np.zeros(len(rows), dtype=np.int64)
        while len(picks) < FAN and nearest.max() > 0:
            picks.append(rows[int(nearest.argmax())])
            d = self._distance(rows, picks[-1])
            owner[d < nearest] = len(picks) - 1
            nearest = np.minimum(nearest, d)
        parts = [rows[owner == p] for p in range(len(picks))]
        if len(picks) == 1 or max(map(len, parts)) > 0.9 * len(rows):  # no spread: cut in equal parts
            parts = np.array_split(rows[np.argsort(far, kind="stable")], FAN)
            picks = [part[0] for part in parts]
        children = [self._build(part, int(p)) for part, p in zip(parts, picks, strict=True) if len(part)]
        pivots = np.array([self.pages[c][0] for c in children])
        self.pages[here] = (pivot, radius, children, pivots, self._distance(pivots, pivot))
        return here

    def _products(self, rows: np.ndarray, query: np.ndarray, exact: np.ndarray | None) -> np.ndarray:
        return self.x[rows] @ query if exact is None else (self._plain[rows] @ exact).astype(np.int64)

    def _exact(self, query: np.ndarray) -> np.ndarray | None:
        """The query as doubles if all products with it are below 2**53."""
        largest = float(np.abs(query).max(initial=0)) * math.sqrt(self.top) * max(len(query), 1)
        if largest >= 2.0**53:
            return None
        if self._plain is None:
            self._plain = self.x.astype(np.float64)
        return query.astype(np.float64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best ``(score, vec_id)`` but ``own``, and how many inner products it took."""
        if not len(self.ids):
            return [], 0
        exact = self._exact(query)
        square = float((query.astype(np.float64) ** 2).sum())
        both = square + self.top
        slack = 1 + 1e-9 * both

        def bound(distance):
            return (both - np.maximum(distance, 0) ** 2) / 2 + slack

        best: list[tuple[int, int]] = []  # (score, -vec_id), worst first
        worst = -math.inf
        root = self.pages[0]
        d = math.sqrt(max(both - 2 * float(self.x[root[0]] @ query), 0.0))
        work = 1
        heap = [(-float(bound(d - root[1])), 0, d)]
        while heap:
            top, page, d = heapq.heappop(heap)
            if -top < worst:
                break
            _, _, children, rows, far = self.pages[page]
            if children is None:
                use = rows[bound(np.abs(d - far)) >= worst]
                work += len(use)
                for s, v in zip(self._products(use, query, exact).tolist(), self.ids[use].tolist(), strict=True):
                    if v != own and (len(best) < k or (s, -v) > best[0]):
                        heapq.heappush(best, (s, -v)) if len(best) < k else heapq.heapreplace(best, (s, -v))
                if len(best) == k:
                    worst = best[0][0]
                continue
            radii = np.array([self.pages[c][1] for c in children])
            near = np.flatnonzero(bound(np.abs(d - far) - radii) >= worst)
            work += len(near)
            to = np.sqrt(np.maximum(both - 2.0 * self._products(rows[near], query, exact), 0))
            for c, e, b in zip(near.tolist(), to.tolist(), bound(to - radii[near]).tolist(), strict=True):
                if b >= worst:
                    heapq.heappush(heap, (-b, children[c], e))
        return [(s, -v) for s, v in sorted(best, key=lambda r: (-r[0], -r[1]))], work


def shard_trees(rows: DataFrame, shards: int, width: int, k: int) -> DataFrame:
    """``(shard, tree)``: every row is in one tree."""

    def work(group: pa.Table) -> pa.Table:
        tree = MTree(np.asarray(group.column("vec_id").combine_chunks()), _matrix(group.column("v").to_pylist(), width), k)
        return pa.table({"shard": group.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    ship_package(rows.sparkSession)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(work, "shard int, tree binary")


def top_k(table: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best rows for each row that meets ``queries``."""
    rows = written(quantised(table, vec, key), "vectors")
    largest = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    numbers = rows.agg(F.count("*"), F.max(F.size("v")), F.max(largest), F.count_if(F.expr(queries))).first()  # four numbers
    count, width, size, asked = (v or 0 for v in numbers)
    if width * size * size >= 2.0**62:
        raise ValueError(f"components up to {size:.0f} in {width} dimensions: an inner product may leave 64 bits")
    shards, chunks = count // SHARD_ROWS + 1, asked // QUERY_CHUNK + 1
    trees = written(shard_trees(rows, shards, width, k), "trees")
    tasks = min(shards * chunks, TASKS)  # one search a task as far as they go; searches are long, whatever their size in bytes
    meet = ["shard", "chunk"]
    per_chunk = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks, *meet)
    chunk = F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(chunks)).cast("int")
    travel = rows.where(queries).select("vec_id", "v", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    travel = travel.repartition(tasks, *meet)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            tree = pickle.loads(left.column("tree")[0].as_py())
            vectors = _matrix(right.column("v").to_pylist(), width)
            for own, vector in zip(right.column("vec_id").to_pylist(), vectors, strict=True):
                out.extend((own, v, s) for s, v in tree.search(vector, own, k)[0])
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    searched = per_chunk.groupBy(*meet).cogroup(travel.groupBy(*meet))
    found = written(searched.applyInArrow(work, "query_id long, vec_id long, score long"), "found")
    discard(trees, rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
