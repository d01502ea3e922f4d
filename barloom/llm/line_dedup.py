"""Removal of lines that many documents share, found with two Bloom filters.

A line's key is the line without blanks at both ends, A-Z in lower case.  Each slice of documents lists its distinct keys, as
SHA-256 cut to 128 bits, with the documents that have them; the texts stay where they are.  Half of a key goes to the filters:
one filter holds keys seen once, the other keys seen again.  Both are cut into segments of ``SEGMENT`` bits by key, and their
number follows the number of keys, so a segment is small whatever the table.  Only what the second filter holds is a suspected
repeat; only those keys are shuffled with their documents, counted exactly and, if wished, given a first occurrence.

Skew: a key costs one row a slice (``SLICE`` bytes of text) before the exact count, however many documents of it have the key;
the count is of distinct (key, document) pairs, combined before each shuffle; joins back are plain equi-joins whose large
partitions Spark splits.

Defined results: a null or empty text is one empty line, which has no key; lines with keys shorter than ``length`` code points stay;
rows with the same ``doc_id`` count as one document, each row is rewritten by itself; rows without ``doc_id`` are not counted
but lose the lines that others have often enough; a ``\\r`` before the line's end belongs to the line; other columns pass
through whatever their names, names beginning with ``_dedup`` excepted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.steps import discard, per_batch, written
from barloom.llm.wordtools import mix, signed, slices

DOCUMENTS = 10
LENGTH = 1
SLICE = 8 << 20  # bytes of text that list their keys together
SEGMENT = 1 << 20  # bits
BITS_PER_KEY = 16
HASHES = 3
_BLANKS = b" \t\n\x0b\x0c\r"
_ADDED = "_dedup_text string, _dedup_lines long, _dedup_dropped long, _dedup_sha256 string"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(_BLANKS).lower() for line in text.split(b"\n")]


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _long_enough(key: bytes, length: int) -> bool:
    return len(key) >= length and (length <= 1 or len(key.decode("utf-8", "replace")) >= length) and key != b""


def key_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(half, key, docs)``: the distinct keys of each slice with the ids of its documents that have them."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SLICE):
            found: dict[bytes, list] = {}
            texts = part.column("text").cast(pa.large_binary())
            for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                for key in set(line_keys(text.as_py() or b"")):
                    if _long_enough(key, length):
                        found.setdefault(key, []).append(doc)
            keys = [_digest(k) for k in found]
            half = np.frombuffer(b"".join(keys), dtype=">i8")[::2].astype(np.int64)
            owners = [sorted({d for d in ids if d is not None}) + [None] * (None in ids) for ids in found.values()]
            yield pa.record_batch({"half": half, "key": pa.array(keys, pa.binary()), "docs": pa.array(owners, pa.list_(pa.int64()))})

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, "half long, key binary, docs array<long>")


class Filters:
    """The filters of one segment: keys seen, and keys seen again."""

    def __init__(self, bits: int = SEGMENT, hashes: int = HASHES) -> None:
        self.once, self.again = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        self._salts = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, hashes + 1)]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([mix(keys ^ salt) % np.uint64(len(self.once)) for salt in self._salts])

    def add(self, keys: np.ndarray, several: np.ndarray) -> None:
        """``several`` tells of each key whether more than one document has it already."""
        keys, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        more = counts > 1
        more[where[several]] = True
        places = self._places(keys)
        self.again[places[:, more | self.once[places].all(axis=0)]] = True
        self.once[places] = True

    def seen_again(self, keys: np.ndarray) -> np.ndarray:
        return self.again[self._places(keys)].all(axis=0)


def suspects(keys: DataFrame) -> DataFrame:
    """``half`` of the keys that more than one document may have: all that have, and few others."""
    segments = keys.count() * BITS_PER_KEY // SEGMENT + 1
    marks = keys.select(F.pmod("half", F.lit(segments)).alias("segment"), "half", (F.size("docs") > 1).alias("several"))

    def work(rows: pa.Table) -> pa.Table:
        filters, step = Filters(), 1 << 16
        batches = rows.combine_chunks().to_batches(step)
        for b in batches:
            filters.add(np.asarray(b.column("half")).view(np.uint64), np.asarray(b.column("several")))
        again = [np.unique(k[filters.seen_again(k)]) for k in (np.asarray(b.column("half")).view(np.uint64) for b in batches)]
        return pa.table({"half": signed(np.unique(np.concatenate(again)))})

    return marks.groupBy("segment").applyInArrow(work, "half long")


def common_lines(docs: DataFrame, documents: int = DOCUMENTS, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """``(key, docs)`` of the suspected repeats, and ``(key, first)`` of the keys that enough documents have."""
    if documents < 2:
        raise ValueError("a line of one document is no repeat")
    keys = written(key_rows(docs, length), "keys")
    often = written(suspects(keys), "suspects")
    repeats = written(keys.join(often, "half").select("key", "docs"), "repeats")
    discard(keys, often)
    one_each = repeats.select("key", F.explode("docs").alias("doc"))
    common = one_each.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
    return repeats, written(common.where(F.col("n") >= documents).select("key", "first"), "common")


def line_dedup(docs: DataFrame, documents: int = DOCUMENTS, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """``docs`` with ``_dedup_text`` (lines that stay), ``_dedup_lines`` (before), ``_dedup_dropped`` and ``_dedup_sha256``.

    Keys of ``length`` code points or more that at least ``documents`` documents have lose their lines: all of them with
    ``keep="none"``; with ``keep="first"`` the first line of the document with the smallest id stays.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    repeats, common = common_lines(docs, documents, length)
    rows = repeats.join(common, "key").select("key", "first", F.explode("docs").alias("_dedup_doc"))
    own = F.collect_set(F.when(F.col("first") == F.col("_dedup_doc"), F.col("key")))
    lists = rows.groupBy("_dedup_doc").agg(F.collect_set("key").alias("_dedup_keys"), own.alias("_dedup_own"))
    lists = written(lists, "line-lists")
    discard(repeats, common)
    carried = docs.columns
    # one way at every size: short lists would be broadcast, longer ones shuffle the texts
    lists = lists.hint("merge")
    both = docs.join(lists, docs.doc_id.cast("long").eqNullSafe(lists["_dedup_doc"]), "left").drop("_dedup_doc")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(_ADDED).fields)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SLICE):
            texts, lines, dropped = [], [], []
            columns = (part.column("text").cast(pa.large_binary()), part.column("_dedup_keys"), part.column("_dedup_own"))
            for text, gone, mine in zip(*columns, strict=True):
                body = text.as_py() or b""
                if not gone.is_valid:
                    texts.append(body)
                    lines.append(body.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone, spare = set(gone.as_py()), set(mine.as_py()) if keep == "first" else set()
                split, stay = body.split(b"\n"), []
                for line, key in zip(split, line_keys(body), strict=True):
                    name = _digest(key)
                    if key == b"" or name not in gone or name in spare:
                        stay.append(line)
                        spare.discard(name)
                texts.append(b"\n".join(stay))
                lines.append(len(split))
                dropped.append(len(split) - len(stay))
            added = [
                pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                pa.array(lines, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ]
            yield pa.record_batch([*[part.column(c) for c in carried], *added], schema.names)

    return per_batch(both, work, schema)


def deduplicated(docs: DataFrame, documents: int = DOCUMENTS, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """``docs`` with the lines that stay; texts that lose nothing, null ones too, are as they were."""
    done = line_dedup(docs, documents, length, keep)
    text = F.when(F.col("_dedup_dropped") > 0, F.col("_dedup_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    done = line_dedup(docs.select("doc_id", "text"))
    return done.selectExpr(
        "doc_id", "_dedup_lines AS n_lines", "_dedup_dropped AS n_dropped", "_dedup_sha256 AS kept_sha256", "_dedup_text AS kept_text"
    )
