"""Exact removal of repeated word sequences by difference-cover anchors.

A window is ``width`` consecutive words of one document.  Positions whose remainder modulo ``period`` lies in the cover
carry an anchor: the hash of the ``width - period + 1`` words that start there.  The remainders' differences reach every
residue, so for two occurrences of one window, wherever they begin, some offset is a cover position in both: they share
an anchor.  Windows that touch no shared anchor are unique and never leave their task; the others are extended to their
full width, told apart by two hashes, of 64 and of 32 bits, made from independent hashes of their words, and the smallest
document of each is found by a grouped minimum.  Both are kept to the end: a window is removed only where both agree.  Among
10^12 different windows some two agree with probability 10^-5; 32 bits more would cost a tenth more disk.

Skew: an anchor or window is sent once per document, grouped minima combine before the shuffle, and joins back are plain
equi-joins whose large partitions Spark splits.  Nothing is collected but lists of one document's own hashes.

Defined results: a null or empty text has no words; a text shorter than the window loses nothing; of rows with the same
``doc_id``, windows count as of one document, and each row is rewritten by itself (rows of one id get the same removals
as far as their words agree); other columns pass through whatever their names, names beginning with ``_dedup`` excepted.
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

from barloom.llm.steps import discard, per_batch, written
from barloom.llm.wordtools import Words, joined, signed, slices, windows

WIDTH = 13
PERIOD = 7
COVER = (0, 1, 3)  # a perfect difference set modulo 7
_ADDED = "_dedup_text string, _dedup_words long, _dedup_removed long, _dedup_sha256 string"


def _anchors(words: Words, hashes: np.ndarray, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions that carry an anchor, and its hash."""
    size = width - period + 1
    row = words.row_of()
    grams = windows(hashes, size)
    here = np.arange(len(grams))
    row = row[: len(grams)]
    place = (here - words.first[row]) % period
    fits = (words.first[row + 1] - here >= size) & (words.counts[row] >= width)
    keep = np.flatnonzero(fits & np.isin(place, cover))
    return keep, grams[keep]


def _once_per_document(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indexes of the distinct (key, document) pairs."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((ids, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    same = ids[order][1:] == ids[order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    return order[new]


def anchor_rows(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``(anchor, doc_id)``, each pair once per slice of rows."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            at, grams = _anchors(words, words.hashes(), width, period, cover)
            ids = np.asarray(part.column("doc_id"))[words.row_of()[at]]
            pick = _once_per_document(ids, grams)
            yield pa.record_batch({"anchor": signed(grams[pick]), "doc_id": ids[pick]})

    return per_batch(docs.select("doc_id", "text"), work, "anchor long, doc_id long")


def _touched(words: Words, at: np.ndarray, width: int, size: int) -> np.ndarray:
    """Windows, by their first word, that hold one of the anchors at ``at``."""
    n = len(words.start)
    marks = np.zeros(n + 1, dtype=np.int64)
    row = words.row_of()[at]
    np.add.at(marks, np.maximum(at - (width - size), words.first[row]), 1)
    np.add.at(marks, at + 1, -1)
    inside = np.cumsum(marks[:-1]) > 0
    return np.flatnonzero(inside & (words.first[words.row_of() + 1] - np.arange(n) >= width))


def _listed(lists: pa.Array, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in its row's list."""
    flat, values = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), values.astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(values + row.astype(np.uint64) * salt, flat + owner.astype(np.uint64) * salt)


def _second(words: Words, width: int) -> np.ndarray:
    """The other hash of each window."""
    return (windows(words.hashes(salt=1), width, salt=width) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_rows(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``(one, two, doc_id)`` of the windows that touch an anchor of the row's list ``_dedup_anchors``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            hashes = words.hashes()
            at, grams = _anchors(words, hashes, width, period, cover)
            shared = at[_listed(part.column("_dedup_anchors"), words.row_of()[at], grams)]
            chosen = _touched(words, shared, width, width - period + 1)
            one, two = windows(hashes, width)[chosen], _second(words, width)[chosen]
            ids = np.asarray(part.column("doc_id"))[words.row_of()[chosen]]
            pick = _once_per_document(ids, one, two)
            yield pa.record_batch({"one": signed(one[pick]), "two": two[pick], "doc_id": ids[pick]})

    return per_batch(docs.select("doc_id", "text", "_dedup_anchors"), work, "one long, two int, doc_id long")


def removals(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``(doc_id, _dedup_windows, _dedup_second)``: per document both hashes of its windows that a smaller document has too."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or period > width:
        raise ValueError("the cover's differences must reach every residue, and the period at most the width")
    rows = anchor_rows(docs, width, period, cover)
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(shared.where("low < high").select("anchor"), "anchors")
    lists = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("_dedup_anchors"))
    lists = written(lists, "anchor-lists")
    discard(shared)
    found = written(window_rows(docs.select("doc_id", "text").join(lists, "doc_id"), width, period, cover), "windows")
    discard(lists)
    first = found.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = written(first.where("low < high").select("one", "two", "low"), "first-windows")
    later = found.join(first, ["one", "two"]).where("doc_id > low")
    # a window comes once a slice of rows, and twice only where rows share a doc_id
    pairs = later.groupBy("doc_id").agg(F.collect_list(F.struct("one", "two")).alias("p"))
    gone = written(pairs.select("doc_id", F.col("p.one").alias("_dedup_windows"), F.col("p.two").alias("_dedup_second")), "removals")
    discard(found, first)
    return gone


def substring_dedup(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``docs`` with ``_dedup_text`` (kept words joined by one space), ``_dedup_words``, ``_dedup_removed`` and
    ``_dedup_sha256``.  A document that loses nothing has the words of its text too, joined by one space."""
    carried = [c for c in docs.columns if c != "text"]
    lists = removals(docs.where("doc_id IS NOT NULL"), width, period, cover)
    both = docs.join(lists, "doc_id", "left")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(_ADDED).fields)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            row = words.row_of()
            gone = np.zeros(len(words.start) + 1, dtype=np.int64)
            if part.column("_dedup_windows").null_count < len(part):
                grams = windows(words.hashes(), width)
                here = np.arange(len(grams))
                fits = words.first[row[: len(grams)] + 1] - here >= width
                fits &= _listed(part.column("_dedup_windows"), row[: len(grams)], grams)
                at = here[fits]
                at = at[_listed(part.column("_dedup_second"), row[at], _second(words, width)[at])]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
            removed = np.cumsum(gone[:-1]) > 0
            texts = joined(words, ~removed)
            lost = np.add.reduceat(np.r_[removed, False].astype(np.int64), words.first[:-1]) * (words.counts > 0)
            out = {c: part.column(c) for c in carried} | {
                "text": part.column("text"),
                "_dedup_text": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                "_dedup_words": pa.array(words.counts, pa.int64()),
                "_dedup_removed": pa.array(lost, pa.int64()),
                "_dedup_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            yield pa.record_batch([out[c] for c in schema.names], schema.names)

    return per_batch(both, work, schema)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the texts that are left: a document that loses words gets its kept words joined by one space,
    the others keep their text as it was."""
    done = substring_dedup(docs, width)
    text = F.when(F.col("_dedup_removed") > 0, F.col("_dedup_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    done = substring_dedup(docs.select("doc_id", "text"))
    return done.selectExpr(
        "doc_id", "_dedup_words AS n_words", "_dedup_removed AS n_removed", "_dedup_sha256 AS kept_sha256", "_dedup_text AS kept_text"
    )
