"""Main text of web pages by removal of site templates.

Every element is hashed twice: by all it holds, bottom-up from the hashes of its children, and by its place, the names, classes
and ids on the way to it (its skeleton).  Spark counts both per host:

* a subtree with the same content on at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages is a template;
* the deepest skeletons of containers that hold ``MAIN_SHARE`` of the host's text are its main region; a container that stands
  at one place on ``PLACE_SHARE`` of the pages, outside the main region, is a template whatever it holds, so menus, adverts and
  footers that change from page to page go too;
* outside articles, such a container goes wherever it is if ``LINK_SHARE`` of its text are links.

What is left of the page's articles (``article``, ``main``, else all), without what is marked as furniture by element, class, id
or role, is its text.  ``_page_rule`` says what decided it: the templates alone, the article element, or the marks.

Skew: rows are keyed by (host, hash) and combined before the shuffle, so a host with a third of all pages is many keys.

Defined results: a null or empty page has the empty text; pages of an unknown host, or of one with few pages, have no templates;
equal pages count as one; rows may share ``page_id``; malformed pages are read in one pass, an unfinished tag is text; other
columns pass through ``extracted`` unless they begin with ``_page``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.page_tree import Templates, article_blocks, is_container, may_be_template, read, subtree_hash, walk
from barloom.llm.steps import discard, per_batch, written

MIN_PAGES = 5
MIN_SHARE = 0.1
PLACE_SHARE = 0.3
MAIN_SHARE = 0.5
LINK_SHARE = 0.6
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_ROW = "_page_host long, _page long, skeleton long, subtree long, depth int, chars long, links long"
_LISTS = ("contents", "anywhere", "outside", "main")


def subtrees(pages: DataFrame) -> DataFrame:
    """One row a page and element: place, content hash (null where only the place counts), depth, text and text in links."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, found = [], []
        for row, source in enumerate(batch.column("html").to_pylist()):
            seen = set()
            for n in walk(read(source)):
                box, own = is_container(n), may_be_template(n)
                if box or own:
                    seen.add((n.skeleton if box else None, subtree_hash(n) if own else None, n.depth, n.chars, n.links))
            rows.extend([row] * len(seen))
            found.extend(seen)
        take = pa.array(np.array(rows, dtype=np.int64))
        columns = [batch.column(c).take(take) for c in ("_page_host", "_page")]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns += [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
        yield pa.record_batch(columns, [c.split()[0] for c in _ROW.split(", ")])

    known = pages.where("html IS NOT NULL AND _page_host IS NOT NULL").select("_page_host", "_page", "html")
    return per_batch(known, work, _ROW)


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(_page_host, kind, value)``: the content hashes and skeletons that make up each host's templates and main region."""
    one_page = found.groupBy("_page_host", "_page").agg(F.max("chars").alias("chars"))  # the page's own is the largest
    hosts = one_page.groupBy("_page_host").agg(F.count("*").alias("pages"), F.sum("chars").alias("all")).where(F.col("pages") >= min_pages)
    same = found.where("subtree IS NOT NULL").select("_page_host", "_page", "subtree").distinct()
    same = same.groupBy("_page_host", F.col("subtree").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    contents = same.join(hosts, "_page_host").where(F.col("n") >= min_share * F.col("pages")).select("_page_host", F.lit("contents").alias("kind"), "value")
    places = found.where("skeleton IS NOT NULL").groupBy("_page_host", "_page", "skeleton", "depth").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = [F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")]
    places = places.groupBy("_page_host", F.col("skeleton").alias("value"), "depth").agg(*sums).where(F.col("n") >= min_pages)
    places = places.join(hosts, "_page_host").where(F.col("n") >= PLACE_SHARE * F.col("pages"))
    large = F.col("chars") >= MAIN_SHARE * F.col("all")
    deepest = places.where(large).groupBy("_page_host").agg(F.max("depth").alias("main_depth"))
    places = places.join(deepest, "_page_host", "left")
    kinds = F.when(large, F.when(F.col("depth") == F.col("main_depth"), F.array(F.lit("main"))).otherwise(F.array().cast("array<string>")))
    linked = F.when(F.col("links") >= LINK_SHARE * F.greatest("chars", F.lit(1)), F.array(F.lit("anywhere"))).otherwise(F.array().cast("array<string>"))
    outside = F.when(F.col("main_depth").isNotNull(), F.array(F.lit("outside"))).otherwise(F.array().cast("array<string>"))
    kinds = kinds.otherwise(F.concat(linked, outside))
    return contents.union(places.select("_page_host", F.explode(kinds).alias("kind"), "value"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with ``_page_text`` and ``_page_rule``."""
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    marked = pages.withColumn("_page_host", F.when(host != "", F.xxhash64(host))).withColumn("_page", F.xxhash64("html"))
    found = written(subtrees(marked), "subtrees")
    recurring = written(templates(found, min_pages, min_share), "templates")
    values = F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("subtree").alias("value")), F.struct(F.lit(False).alias("c"), F.col("skeleton").alias("value"))))
    here = found.select("_page", "_page_host", values.alias("v")).where("v.value IS NOT NULL").select("_page", "_page_host", "v.*").distinct()
    listed = here.join(recurring.withColumn("c", F.col("kind") == "contents"), ["_page_host", "c", "value"])
    lists = [F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(f"_page_{k}") for k in _LISTS]
    lists = written(listed.groupBy("_page", "_page_host").agg(*lists), "page-templates")
    discard(found, recurring)
    carried = pages.columns
    # one way at every size: short lists would be broadcast, longer ones shuffle the pages
    both = marked.join(lists.hint("merge"), ["_page", "_page_host"], "left").select(*carried, *[f"_page_{k}" for k in _LISTS])
    schema = T.StructType([*pages.schema.fields, T.StructField("_page_text", T.StringType()), T.StructField("_page_rule", T.StringType())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, rules = [], []
        columns = [batch.column(c).to_pylist() for c in ("html", *[f"_page_{k}" for k in _LISTS])]
        for source, *sets in zip(*columns, strict=True):
            blocks, rule = article_blocks(read(source), Templates(*[frozenset(s or ()) for s in sets])) if source else ([], "empty")
            texts.append("\n".join(blocks))
            rules.append(rule)
        yield pa.record_batch([*[batch.column(c) for c in carried], pa.array(texts, pa.string()), pa.array(rules, pa.string())], schema.names)

    return per_batch(both, work, schema)


def report(pages: DataFrame) -> DataFrame:
    done = extracted(pages.select("page_id", "url", "html"))
    size = F.length("_page_text").cast("long")
    return done.select("page_id", "url", F.col("_page_text").alias("text"), size.alias("n_chars"), F.col("_page_rule").alias("rule"))
