"""Removal of repeated byte strings with suffix arrays over shards.

A string of ``WIDTH`` bytes is repeated if it also starts anywhere else.  Every such string holds a minimizer: the 32-byte gram
with the smallest hash (the leftmost of equals), the same at the same offset in both places.  Neighbouring starts with one
minimizer make a run; its content is the bytes its strings cover.  So a repeated string lies in two runs with the same
minimizer, and runs whose minimizer occurs once are done.

Runs with the same content, told by a BLAKE2 digest, are one class.  Classes of one minimizer go to one shard, where a suffix
array and permuted common prefixes tell which starts have a common prefix of ``WIDTH`` bytes with a neighbour; a class of
several runs needs no sorting, each of its strings occurs in all of them.

A minimizer with more than ``SHARD_CLASSES`` classes is split by radix.  Equal strings have it at the same offset, so the strings
of a class are cut into two halves by the bytes before the minimizer, and each half is told apart by all the bytes around it
that its strings have in common.  Groups that are still too large are cut again: the halves shrink, the common bytes grow,
and after nine cuts they are the string itself.  All others are sorted.

Skew: groups are counted and combined before anything is gathered; a shard has about ``SHARD_BYTES`` of content; joins back to
the runs deal out keys that hold more than a thousandth of all runs.

Defined results: a null text has no bytes; texts shorter than ``WIDTH`` lose nothing; equal rows are each other's copies, so
they lose every string; documents with the same ``doc_id`` and text are told apart by number only; other columns pass through
unless they begin with ``_dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.steps import discard, hot_keys, join_hot, per_batch, written
from barloom.llm.suffix_array import permuted_common_prefixes, suffix_array
from barloom.llm.wordtools import byte_sums, mix, signed, slices, text_bytes
from barloom.plans.staging import ship_package

WIDTH = 400
GRAM = 32
SHARD_BYTES = 1 << 20
SHARD_CLASSES = 4096
_CLASS = ["anchor", "digest", "lead", "starts"]
_CLASS_TYPES = "anchor long, digest long, lead int, starts int"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in three passes."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(raw: np.ndarray, rows: np.ndarray, width: int, gram: int):
    """Runs of the rows' strings: row, first start, number of starts, minimizer's place, its hash, the content's hash."""
    sums, down = byte_sums(raw)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_minimum(key, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.maximum(np.diff(rows) - width + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + rows[row]
    place = place[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    begin, at, count = start[new], place[new], np.diff(np.r_[new, len(row)])
    end = begin + count - 1 + width
    body = memoryview(np.ascontiguousarray(raw))
    # contents are longer than sums of bytes can tell apart
    digest = b"".join(hashlib.blake2b(body[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True))
    return row[new], begin - rows[row[new]], count, at - begin, grams[at], np.frombuffer(digest, dtype=np.uint64)


def minimizer_runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            raw, rows = text_bytes(part.column("text"))
            if not (np.diff(rows) >= width).any():
                continue
            row, begin, count, lead, anchor, digest = _runs(raw, rows, width, gram)
            take = pa.array(row)
            yield pa.record_batch(
                {
                    "anchor": signed(anchor), "digest": signed(digest), "lead": lead.astype(np.int32), "starts": count.astype(np.int32),
                    "doc_id": part.column("doc_id").take(take), "_text": part.column("_text").take(take), "begin": begin.astype(np.int32),
                }
            )

    return per_batch(docs.select("doc_id", "_text", "text"), work, f"{_CLASS_TYPES}, doc_id long, _text long, begin int")


def class_contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` classes with their bytes, cut from one of the documents that have them."""
    lists = wanted.groupBy("doc_id", "_text").agg(F.collect_list(F.struct(*_CLASS, "begin")).alias("_cuts"))
    same = docs.doc_id.eqNullSafe(lists.doc_id) & (docs._text == lists._text)
    # rows that agree in both would give the same contents twice
    both = docs.join(lists, same).select(docs.doc_id, docs._text, "text", "_cuts").dropDuplicates(["doc_id", "_text"])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            raw, rows = text_bytes(part.column("text"))
            raw, out = raw.tobytes(), []
            for row, cuts in enumerate(part.column("_cuts").to_pylist()):
                for c in cuts:
                    at = int(rows[row]) + c["begin"]
                    out.append({**{k: c[k] for k in _CLASS}, "content": raw[at : at + c["starts"] - 1 + width]})
            yield pa.RecordBatch.from_pylist(out, _arrow_classes("content", pa.binary()))

    return per_batch(both.select("text", "_cuts"), work, f"{_CLASS_TYPES}, content binary")


def _arrow_classes(name: str, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("lead", pa.int32()), ("starts", pa.int32()), (name, kind)])


def _stretches(flags: np.ndarray) -> np.ndarray:
    """Begins and ends of the runs of true values, one pair a row."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge.reshape(-1, 2)


def repeated_in_shard(contents: list[bytes], width: int) -> list[np.ndarray]:
    """Per content, the stretches of starts whose string of ``width`` bytes starts elsewhere in the shard."""
    m = len(contents)
    size = np.array([len(c) for c in contents], dtype=np.int64)
    first = np.cumsum(size + 1) - size - 1
    t = np.zeros(int(size.sum()) + m + 1, dtype=np.int32)
    body = np.frombuffer(b"".join(contents), dtype=np.uint8).astype(np.int32) + m + 1
    t[np.arange(len(body)) + np.repeat(np.arange(m), size)] = body
    t[first + size] = np.arange(1, m + 1)  # each content ends with a sign of its own
    before, common = permuted_common_prefixes(t, suffix_array(t))
    hit = np.zeros(len(t) + 1, dtype=bool)
    long = np.flatnonzero(common >= width)
    hit[long] = True
    hit[before[long]] = True
    return [_stretches(hit[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]


_PART = f"{_CLASS_TYPES}, low int, high int, group binary, content binary"


def _hits_by_suffix_array(parts: DataFrame, shards: int, width: int) -> DataFrame:
    """``(class, hits)``: stretches of starts in the class whose strings occur elsewhere among the parts of their group."""

    def work(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, [(k, "ascending") for k in (*_CLASS, "low")]))
        found = repeated_in_shard(shard.column("content").to_pylist(), width)
        keep = [k for k, f in enumerate(found) if len(f)]
        out = shard.select(_CLASS).take(pa.array(keep, pa.int64()))
        first = [v.as_py() for v in shard.column("first")]
        hits = [(found[k] + first[k]).astype(np.int32).tolist() for k in keep]
        return out.append_column("hits", pa.array(hits, pa.list_(pa.list_(pa.int32()))))

    ship_package(parts.sparkSession)
    # a part's first start in its class: the one with the most bytes before the minimizer
    first = F.greatest(F.lit(0), F.col("lead") - F.col("high") + 1).alias("first")
    sharded = parts.select(*_CLASS, "low", first, "content", F.pmod(F.xxhash64("group"), F.lit(shards)).alias("_shard"))
    return sharded.groupBy("_shard").applyInArrow(work, f"{_CLASS_TYPES}, hits array<array<int>>")


def halves(parts: DataFrame, width: int, gram: int) -> DataFrame:
    """Each part cut in two by the bytes before the minimizer, and grouped by the bytes that all strings of a half have.

    A part holds the strings with ``low`` to ``high - 1`` bytes before the minimizer; all of them have ``low`` bytes before it and
    ``width - gram - high + 1`` behind it.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for p in batch.to_pylist():
            first = max(0, p["lead"] - p["high"] + 1)
            middle = (p["low"] + p["high"] + 1) // 2
            for low, high in ((p["low"], middle), (middle, p["high"])):
                begin, last = max(0, p["lead"] - high + 1), min(p["starts"] - 1, p["lead"] - low)
                if low < high and begin <= last:
                    at = p["lead"] - first  # of the minimizer in the part's content
                    common = p["content"][at - low : at + width - high + 1]
                    group = hashlib.sha256(p["group"] + b"%d %d " % (low, high) + common).digest()[:16]
                    out.append({**p, "low": low, "high": high, "group": group, "content": p["content"][begin - first : last - first + width]})
        yield pa.RecordBatch.from_pylist(out, batch.schema)

    return per_batch(parts, work, _PART)


def _hits(contents: DataFrame, width: int, gram: int) -> DataFrame:
    """``(class, hits)`` of the classes in ``contents``: suffix arrays over groups of at most ``SHARD_CLASSES`` parts."""
    whole = [F.lit(0).alias("low"), F.lit(width - gram + 1).alias("high"), F.unhex(F.hex("anchor")).alias("group")]
    parts, found = contents.select(*_CLASS, *whole, "content"), None
    span = width - gram + 1
    while True:
        crowd = parts.groupBy("group").agg(F.count("*").alias("n")).where(f"n > {SHARD_CLASSES}")
        crowd = written(crowd, "crowded")
        few = parts.join(crowd.select("group"), "group", "left_anti")
        volume = parts.agg(F.sum(F.length("content"))).first()[0] or 0  # one number
        sorted_ = written(_hits_by_suffix_array(few, volume // SHARD_BYTES + 1, width), "hits")
        found = sorted_ if found is None else found.union(sorted_)
        if crowd.isEmpty():
            return found
        if span == 1:  # a group's parts are one string
            same = parts.join(crowd.select("group"), "group").select(*_CLASS, F.array(F.array(F.col("lead") - F.col("low"), F.col("lead") - F.col("low") + 1)).alias("hits"))
            return found.union(written(same, "hits"))
        cut = written(halves(parts.join(crowd.select("group"), "group").select([f.split()[0] for f in _PART.split(", ")]), width, gram), "halves")
        discard(crowd)
        parts, span = cut, (span + 1) // 2


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, _text, _spans)``: stretches ``[begin, end)`` of bytes to remove, which may overlap."""
    runs = written(minimizer_runs(docs, width, gram), "runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    shared = written(shared.where("n > 1").select("anchor", "n", (F.col("low") < F.col("high")).alias("mixed")), "shared")
    rows = runs.count()
    hot = hot_keys(shared, ["anchor"], "n", rows)
    members = written(join_hot(runs, shared.drop("n"), ["anchor"], hot, ["doc_id", "begin"]), "members")
    discard(runs, shared)
    place = F.min(F.struct("doc_id", "_text", "begin")).alias("at")
    classes = members.groupBy(*_CLASS, "mixed").agg(F.count("*").alias("n"), place).select(*_CLASS, "mixed", "n", "at.*")
    classes = written(classes, "classes")
    contents = written(class_contents(docs, classes.where("mixed"), width), "contents")
    hits = _hits(contents, width, gram)
    whole = classes.where("n > 1").select(*_CLASS, F.array(F.array(F.lit(0), "starts")).alias("hits"))
    hits = hits.union(whole).groupBy(*_CLASS).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    hits = written(hits, "class-hits")
    discard(contents)
    found = join_hot(members, hits, _CLASS, hot_keys(classes, _CLASS, "n", rows), ["doc_id", "begin"])
    bytes_of = F.transform("hits", lambda h: F.struct((F.col("begin") + h[0]).alias("begin"), (F.col("begin") + h[1] - 1 + width).alias("end")))
    found = found.select("doc_id", "_text", bytes_of.alias("s"))
    found = written(found.groupBy("doc_id", "_text").agg(F.flatten(F.collect_list("s")).alias("_spans")), "spans")
    discard(members, hits, classes)
    return found


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``_dedup_bytes``, ``_dedup_spans`` (maximal removed stretches of bytes), ``_dedup_removed``,
    ``_dedup_kept`` (the bytes that are left) and ``_dedup_sha256``."""
    carried = docs.columns
    docs = docs.withColumn("_text", F.xxhash64("text"))
    spans = repeated_spans(docs.select("doc_id", "_text", "text"), width, gram).withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_of")
    both = docs.join(spans, docs.doc_id.eqNullSafe(F.col("_id")) & (docs._text == F.col("_of")), "left").select(*carried, "_spans")
    added = "_dedup_bytes long, _dedup_removed long, _dedup_spans array<struct<begin:int,end:int>>, _dedup_kept binary, _dedup_sha256 string"
    schema = T.StructType([f for f in docs.schema.fields if f.name != "_text"] + T._parse_datatype_string(added).fields)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            raw, rows = text_bytes(part.column("text"))
            sizes, lost, spans, kept = np.diff(rows), [], [], []
            for row, found in enumerate(part.column("_spans")):
                body = raw[rows[row] : rows[row + 1]]
                if not found.is_valid or not len(found.values):
                    spans.append([])
                    lost.append(0)
                    kept.append(body.tobytes())
                    continue
                step = np.zeros(len(body) + 1, dtype=np.int64)
                np.add.at(step, np.asarray(found.values.field("begin")), 1)
                np.add.at(step, np.asarray(found.values.field("end")), -1)
                gone = np.cumsum(step[:-1]) > 0
                spans.append([{"begin": a, "end": b} for a, b in _stretches(gone).tolist()])
                lost.append(int(gone.sum()))
                kept.append(body[~gone].tobytes())
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            added = [pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(sha)]
            yield pa.record_batch([*[part.column(c) for c in carried], *added], schema.names)

    return per_batch(both, work, schema)


def report(docs: DataFrame) -> DataFrame:
    done = suffix_dedup(docs.select("doc_id", "text"))
    return done.selectExpr(
        "doc_id", "_dedup_bytes AS n_bytes", "_dedup_removed AS n_removed", "cast(size(_dedup_spans) AS long) AS n_spans",
        "_dedup_sha256 AS kept_sha256", "make_valid_utf8(cast(_dedup_kept AS string)) AS kept_text",
    )
