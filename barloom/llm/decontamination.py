"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index holds a posting ``(term, doc_id, pos)`` for every occurrence in the corpus of a benchmark word; it is written
once.  A window (``width`` consecutive words of an item, or a shorter item as a whole) is looked up from its rarest terms:
the postings of the rarest give the places where the window could begin, the lists of the next rarest, shifted by their
offsets, are intersected on ``(term, doc_id, pos)``, and what is left is compared word by word with the text.

Skew: terms are looked up rarest first, so frequent words never expand; every other join has the document in its key.  The
benchmark's terms and windows are broadcast only when their bytes are counted and within ``BROADCAST_BYTES``, else joined by
shuffle.

Defined results: a null text has no words; an item without words has no window; equal items count once by ``item_id``; the words
of an item without id are hit like others, but it is not among the items; a null ``doc_id`` is a value like others; rows with the same ``doc_id`` are each compared with their own text; other
columns pass through ``decontaminated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.steps import discard, written

WIDTH = 13
LISTS = 3  # posting lists intersected before the exact comparison
BROADCAST_BYTES = 64 << 20
TERM_BYTES = 32  # of a row with one term, as joined in memory
WORD_BYTES = 96  # of a window's word with its probe, its letters aside
SHARE = 20  # contaminated from one hit word in so many words
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gapped_words(text: str | Column = "text") -> Column:
    """The words behind one empty entry; a last empty entry is possible.  Word ``i`` (from 0) is entry ``i + 1``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.concat(F.lit(" "), F.translate(F.coalesce(c, F.lit("")), _UPPER, _LOWER)), _GAP)


def _number_of_words(entries: str) -> Column:
    return F.size(entries) - 1 - F.when(F.element_at(entries, -1) == "", 1).otherwise(0)


def _bounded(df: DataFrame, size: int) -> DataFrame:
    """Broadcast ``df`` if it has few bytes."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _window_bytes(ranked: DataFrame) -> int:
    """Bytes of windows with their probes; one number."""
    letters = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    return ranked.agg(F.sum(letters + WORD_BYTES * F.size("words"))).first()[0] or 0


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(item_id, at, words)``: every window of every item and the word of the item where it begins."""
    entries = items.select("item_id", gapped_words().alias("_e")).withColumn("_n", _number_of_words("_e")).where("_n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_n") - width))
    cut = entries.select("item_id", "_e", F.least("_n", F.lit(width)).alias("_w"), F.explode(starts).alias("at"))
    return cut.select("item_id", "at", F.expr("slice(_e, at + 2, _w)").alias("words")).distinct()


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(term, doc_id, pos)`` of the words in ``terms`` (column ``word``); a term is its word's 64-bit hash."""
    wanted = written(terms.select(F.xxhash64("word").alias("term")).distinct(), "terms")
    words = docs.select("doc_id", F.posexplode(gapped_words()).alias("_at", "_word"))
    words = words.select(F.xxhash64("_word").alias("term"), "doc_id", (F.col("_at") - 1).alias("pos"))
    return written(words.join(_bounded(wanted, TERM_BYTES * wanted.count()), "term", "left_semi"), "postings")


def _ranked_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` with their offsets and terms from the rarest up (``probes``); those with an unseen word are left out."""
    seen = index.groupBy("term").agg(F.count("*").alias("often"))
    terms = windows.select("item_id", "at", "words", F.posexplode("words").alias("off", "_word"))
    terms = terms.withColumn("term", F.xxhash64("_word")).join(seen, "term")
    ranked = terms.groupBy("item_id", "at", "words").agg(F.array_sort(F.collect_list(F.struct("often", "off", "term"))).alias("probes"))
    return written(ranked.where(F.size("probes") == F.size("words")), "windows")


def phrase_candidates(index: DataFrame, windows: DataFrame, lists: int = LISTS) -> DataFrame:
    """``(item_id, at, words, doc_id, start)``: places that agree with a window on its ``lists`` rarest terms."""
    ranked = _ranked_windows(index, windows)
    probe = ranked.withColumn("term", F.expr("probes[0].term"))
    found = index.join(_bounded(probe, _window_bytes(ranked)), "term").withColumn("start", F.expr("pos - probes[0].off")).where("start >= 0")
    found = written(found.drop("term", "pos"), "candidates")
    terms = TERM_BYTES * ranked.count()
    for k in range(1, lists):
        wanted = ranked.select(F.expr(f"get(probes, {k}).term").alias("term")).distinct()
        postings = index.join(_bounded(wanted, terms), "term", "left_semi").select(
            F.col("term").alias("_term"), F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos")
        )
        probed = found.where(F.size("probes") > k).withColumn("_t", F.expr(f"get(probes, {k}).term")).withColumn("_p", F.expr(f"start + get(probes, {k}).off"))
        same = (F.col("_t") == F.col("_term")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_p") == F.col("_pos"))
        both = probed.join(postings, same, "left_semi").drop("_t", "_p")
        fewer = written(both.union(found.where(F.size("probes") <= k).select(both.columns)), "candidates")
        discard(found)
        found = fewer
    discard(ranked)
    return found.select("item_id", "at", "words", "doc_id", "start")


def exact_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``_entries`` (see ``gapped_words``) and ``_matches``, the array of ``(start, length, item_id, at)`` at
    which a window of an item occurs; empty where none does."""
    windows = written(item_windows(items, width), "item-windows")
    index = positional_index(docs, windows.select(F.explode("words").alias("word")))
    place = F.struct("start", F.size("words").alias("length"), "item_id", "at", "words")
    places = phrase_candidates(index, windows).groupBy("doc_id").agg(F.collect_set(place).alias("_places"))
    places = written(places.withColumnRenamed("doc_id", "_doc"), "places")
    discard(index, windows)
    both = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    both = both.withColumn("_entries", gapped_words())
    true = F.expr("filter(coalesce(_places, array()), p -> slice(_entries, p.start + 2, p.length) = p.words)")
    kept = F.transform(true, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["item_id"].alias("item_id"), p["at"].alias("at")))
    return both.withColumn("_matches", kept).drop("_places")


def proximity_matches(docs: DataFrame, items: DataFrame, reach: int, width: int = WIDTH) -> DataFrame:
    """``(item_id, at, doc_id, pos)``: occurrences of a window's rarest word that have all the window's other words, in any
    order, at most ``reach`` words away."""
    windows = written(item_windows(items, width), "item-windows")
    index = positional_index(docs, windows.select(F.explode("words").alias("word")))
    ranked = _ranked_windows(index, windows).withColumn("terms", F.array_distinct(F.col("probes.term")))
    pivot = index.join(_bounded(ranked.withColumn("term", F.expr("probes[0].term")), _window_bytes(ranked)), "term")
    wanted = pivot.select("item_id", "at", "doc_id", "pos", F.size("terms").alias("_n"), F.explode("terms").alias("term"))
    cell = lambda c: F.floor(F.col(c) / (reach + 1))
    wanted = wanted.withColumn("_cell", F.explode(F.sequence(cell("pos") - 1, cell("pos") + 1)))
    near = index.select("term", F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"), cell("pos").alias("_cell"))
    met = wanted.join(near, ["term", "_cell"]).where(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.abs(F.col("pos") - F.col("_pos")) <= reach))
    counted = met.groupBy("item_id", "at", "doc_id", "pos", "_n").agg(F.count_distinct("term").alias("_met"))
    return counted.where("_met = _n").select("item_id", "at", "doc_id", "pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_items`` (sorted item ids as strings) and ``_contaminated``."""
    found = exact_matches(docs, items, width).withColumn("_n_words", _number_of_words("_entries").cast("long"))
    hit = F.expr(
        "aggregate(array_sort(_matches), named_struct('upto', 0, 'hit', 0L), (a, m) -> named_struct('upto', greatest(a.upto, m.start + m.length),"
        " 'hit', a.hit + greatest(0, m.start + m.length - greatest(a.upto, m.start))), a -> a.hit)"
    )
    found = found.withColumn("_n_hit", hit)
    found = found.withColumn("_items", F.expr("array_sort(array_distinct(array_compact(transform(_matches, m -> cast(m.item_id AS string)))))"))
    return found.withColumn("_contaminated", F.expr(f"_n_hit > 0 AND {SHARE} * _n_hit >= _n_words")).drop("_matches", "_entries")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), items)
    return found.selectExpr(
        "doc_id", "_n_words AS n_words", "_n_hit AS n_hit", "cast(size(_items) AS long) AS n_items",
        "sha2(array_join(_items, ','), 256) AS items_sha256", "_contaminated AS contaminated",
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return contamination(docs, items).where("NOT _contaminated").select(docs.columns)
