"""Near-duplicate groups by circulant MinHash, every link confirmed on full shingle sets.

Signature: one permutation scatters the shingles over the 32-bit circle, the second is read at circular shifts: coordinate
``k`` is the minimum of ``pi(sigma(x) + k)``.  Two permutations give all ``BANDS * ROWS`` coordinates.  A pair at exactly
0.75 misses all 32 bands of 4 with probability ``(1 - 0.75**4)**32``, about 5 in a million.

Documents with equal sets are one node.  A bucket with several nodes links them to a leader (a star, not all pairs);
buckets that still hold different components get new leaders, and at last their remaining pairs across components are
tested one by one, so no link between components is lost.  Pairs inside one component need no test, nor pairs whose sizes and
unshared shingles rule the link out.

Skew: a group of copies is one node, a bucket of m nodes makes m - 1 pairs a round, and joins are plain equi-joins whose
large partitions Spark splits.

Defined results: a null text or one without words has no shingles and links with nothing; fewer than five words make one
shingle of the whole sequence; rows with the same ``doc_id`` are one document, with the set that sorts first; a null
``doc_id`` links with nothing; other columns are not read.  Of rows with the same ``doc_id``, ``deduplicated`` keeps one, the first
by text, null last, then by the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.steps import discard, per_batch, written
from barloom.llm.wordtools import Words, mix, signed, slices, windows

SHINGLE = 5
BANDS, ROWS = 32, 4
PERCENT = 75
STAR_ROUNDS = 2
GROUPS = 32  # of shingles, for the bound on what two sets can share


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ordered by row and value, and their rows."""
    hashes = words.hashes(lower=True)
    row = words.row_of()
    grams = windows(hashes, size)
    fits = np.flatnonzero(words.first[row[: len(grams)] + 1] - np.arange(len(grams)) >= size)
    values, rows = [grams[fits]], [row[fits]]
    for n in range(1, size):
        short = words.first[:-1][words.counts == n]
        if len(short):
            values.append(windows(hashes, n, salt=n)[short])
            rows.append(row[short])
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(values: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for each set; set ``i`` is ``values[begins[i]:begins[i + 1]]``, none empty."""
    place = (mix(values) >> np.uint64(32)).astype(np.uint32)  # sigma
    out = np.empty((size, len(begins)), dtype=np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_pi(place + np.uint32(k)), begins)
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, set size ``n``, 128-bit set key ``(one, two)`` and the band values of each row."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            value, row = _sets(words, size)
            sizes = np.bincount(row, minlength=len(part))
            full = np.flatnonzero(sizes)
            one, two = np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
            flat, ends = np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int32)
            if len(full):
                begins = (np.cumsum(sizes) - sizes)[full]
                one[full] = np.add.reduceat(mix(value ^ np.uint64(1)), begins)
                two[full] = np.add.reduceat(mix(value ^ np.uint64(2)), begins)
                signs = circulant_signature(value, begins, bands * rows).astype(np.uint64)
                band = np.zeros((bands, len(full)), dtype=np.uint64)
                for k in range(rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + signs[k::rows] + np.arange(bands, dtype=np.uint64)[:, None])
                flat = signed(np.ascontiguousarray(band.T).ravel())
                ends[1:] = np.cumsum((sizes > 0) * bands)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array(sizes, pa.int64()),
                    "one": signed(one),
                    "two": signed(two),
                    "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                }
            )

    return per_batch(docs.select("doc_id", "text"), work, "doc_id long, n long, one long, two long, bands array<long>")


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, one, two, shingles, groups)`` of each row; ``groups`` counts the shingles by value modulo ``GROUPS``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            value, row = _sets(Words(part.column("text")), size)
            sizes = np.bincount(row, minlength=len(part))
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            begins = (np.cumsum(sizes) - sizes)[full]
            group = (value & np.uint64(GROUPS - 1)).astype(np.int64)
            by_group = np.bincount(row * GROUPS + group, minlength=len(part) * GROUPS).astype(np.int32).reshape(-1, GROUPS)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id").take(pa.array(full)),
                    "one": signed(np.add.reduceat(mix(value ^ np.uint64(1)), begins)),
                    "two": signed(np.add.reduceat(mix(value ^ np.uint64(2)), begins)),
                    "shingles": pa.ListArray.from_arrays(pa.array(np.r_[begins, len(value)].astype(np.int32)), pa.array(signed(value))),
                    "groups": pa.FixedSizeListArray.from_arrays(pa.array(by_group[full].ravel()), GROUPS).cast(pa.list_(pa.int32())),
                }
            )

    return per_batch(docs.select("doc_id", "text"), work, "doc_id long, one long, two long, shingles array<long>, groups array<int>")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of the edges ``(a, b)``: the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label's own label.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node")
        lower = written(lower.select("node", F.col("component").alias("was"), F.least("component", "low").alias("component")), "lower")
        owner = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = written(lower.join(owner, "component").select("node", "was", F.col("top").alias("component")), "labels")
        discard(lower)
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("was")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    whole = F.size("left") + F.size("right") - F.col("shared")
    both = pairs.join(right, "b").join(left, "a").withColumn("shared", shared)
    return both.where(100 * F.col("shared") >= percent * whole).select("a", "b")


def _several(members: DataFrame, column: str) -> DataFrame:
    """The members of buckets in which ``column`` has more than one value."""
    mixed = members.groupBy("bucket").agg(F.min(column).alias("low"), F.max(column).alias("high")).where("low < high")
    return members.join(mixed.select("bucket"), "bucket")


def _limits(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, n, cap, sketch)`` of the sets that can have a partner.

    A shingle that only one set has is in no intersection.  With ``m`` others in a set of ``n`` the condition
    ``(100 + percent) * shared >= percent * (n + size)`` bounds the partner's size by ``cap``; it also is at least ``percent``
    of ``n``.  ``sketch`` counts the others by group: two sets share at most the sum of the smaller counts.
    """
    group = F.pmod("g", F.lit(GROUPS)).cast("int").alias("group")
    own = sets.select("doc_id", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("doc_id").alias("node"))
    own = own.where("c = 1").groupBy("node", group).agg(F.count("*").cast("int").alias("c"))
    own = own.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("group", "c"))).alias("own"), F.sum("c").alias("lost"))
    sizes = sets.select(F.col("doc_id").alias("node"), F.size("shingles").cast("long").alias("n"), "groups").join(own, "node", "left")
    cap = F.expr(f"((n - coalesce(lost, 0)) * {100 + percent}) div {percent} - n")
    sketch = F.expr("transform(groups, (c, g) -> c - coalesce(own[g], 0))")
    return sizes.withColumn("cap", cap).where(f"100 * cap >= {percent} * n").select("node", "n", "cap", sketch.alias("sketch"))


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Confirmed links ``(a, b)`` between nodes that span every component of the graph of all links.

    ``nodes``: ``(doc_id, n, one, two, bands)``, one row for each distinct set.
    """
    buckets = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    members = written(_several(buckets, "node"), "members")
    involved = nodes.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select("doc_id", "one", "two")
    involved = written(involved, "involved")
    # one way at every size: a small list would be broadcast, a longer one shuffle the texts
    texts = docs.select("doc_id", "text").join(involved.select("doc_id").hint("merge"), "doc_id")
    sets = written(shingle_sets(texts, size).join(involved, ["doc_id", "one", "two"]).dropDuplicates(["doc_id"]), "sets")
    able = written(_limits(sets, percent), "able")
    open_ = written(_several(members.join(able, "node"), "node"), "members")
    discard(members, involved)
    # the copy nearest to the others meets them in most buckets
    mass = open_.join(open_.groupBy("bucket").agg(F.count("*").alias("k")), "bucket").groupBy("node").agg(F.sum("k").alias("mass"))
    open_ = written(open_.join(mass, "node").withColumn("component", F.col("node")), "members")
    most = "aggregate(zip_with(sketch, other_sketch, (x, y) -> least(x, y)), 0, (t, v) -> t + v)"
    fits = f"least(n, m) * 100 >= greatest(n, m) * {percent} AND n <= other_cap AND m <= cap AND {100 + percent} * {most} >= {percent} * (n + m)"
    found = tried = None
    for turn in range(STAR_ROUNDS + 1):
        first = -F.col("mass") if turn == 0 else F.xxhash64("node", F.lit(turn))
        rank = F.struct(first.alias("rank"), "node", "n", "cap", "sketch", "component")
        leaders = open_.groupBy("bucket").agg(F.min(rank).alias("lead"))
        if turn < STAR_ROUNDS:
            other = leaders.selectExpr("bucket", "lead.node b", "lead.n m", "lead.cap other_cap", "lead.sketch other_sketch", "lead.component other")
            pairs = open_.join(other, "bucket").where("component <> other")
        else:  # each remaining pair has one end outside its bucket's leading component
            main = leaders.selectExpr("bucket", "lead.component AS main")
            outside = open_.join(main, "bucket").where("component <> main").drop("main", "mass")
            other = open_.selectExpr("bucket", "node b", "n m", "cap other_cap", "sketch other_sketch", "component other")
            pairs = outside.join(other, "bucket").where("component <> other")
        pairs = pairs.where(fits).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = written(_alike(pairs, sets, percent), "links")
        found = more if found is None else found.union(more)
        if turn == STAR_ROUNDS:
            return found
        labels = components(found)
        now = open_.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = written(_several(now, "component"), "members")
        if open_.isEmpty():
            return found
    return found


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    signs = written(signatures(docs, size), "signatures")
    one_each = signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("one", "two", "n", "bands")).alias("s"))
    one_each = one_each.select("doc_id", "s.*")
    classes = one_each.groupBy("one", "two").agg(F.min(F.struct("doc_id", "n", "bands")).alias("s"))
    nodes = written(classes.select("one", "two", "s.*"), "nodes")
    labels = components(links(docs, nodes, percent, size))
    top = nodes.join(labels, nodes.doc_id == labels.node, "left").select("one", "two", F.coalesce("component", "doc_id").alias("component_id"))
    top = written(top, "tops")
    of = one_each.select("doc_id", "one", "two").join(top, ["one", "two"]).select("doc_id", "component_id")
    done = signs.select("doc_id", F.col("n").alias("n_shingles")).join(written(of, "components"), "doc_id", "left")
    done = done.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the smallest of their group, and one row for each ``doc_id``."""
    groups = near_groups(docs)
    gone = groups.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.to_json(F.struct(c)) for c in rest])
    first = kept.join(again, "doc_id").withColumn("_near_row", F.row_number().over(order)).where("_near_row = 1")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(first.select(docs.columns))
