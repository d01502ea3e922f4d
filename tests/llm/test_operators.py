"""The operators on small tables: odd rows, brute force, SQL, and results that do not depend on how they are reached."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import (
    chat_format,
    decontamination,
    html_extraction,
    language_id,
    licence_scan,
    metric_search,
    mixing,
    near_dedup,
    page_tree,
    queries,
    substring_dedup,
    suffix_array,
    suffix_dedup,
)

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 6))) for _ in range(400)]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 77)
BASE = prose(120, 78)


def near(text, k, seed):
    words, r = text.split(), random.Random(seed)
    for _ in range(k):
        words[r.randrange(len(words))] = "zz" + str(r.randrange(10**6))
    return " ".join(words)


def texts():
    rows = [None, "", "   \t\n", "one", "Two words", "four words in all", "Two  WORDS", "😀 ¿ß 中文", "123 !!", prose(300, 1), PASSAGE]
    rows += [f"{prose(20, s)} {PASSAGE}\n{prose(15, s + 50)}" for s in range(2, 8)]
    rows += [BASE, BASE, BASE.upper(), *(near(BASE, k, k) for k in range(1, 12)), prose(12, 9), prose(13, 10), prose(13, 10)]
    rows += ["For " * 400, "For " * 300, BASE + " " + BASE, prose(4000, 11) + " " + PASSAGE + " " + prose(4000, 12)]
    return rows


@pytest.fixture(scope="module")
def documents():
    body = texts()
    n = len(body)
    return pd.DataFrame(
        {
            "doc_id": range(10, 10 + n),
            "text": body,
            "lang": [None if i % 7 == 0 else ("en", "fr")[i % 2] for i in range(n)],
            "source": [None if i % 11 == 0 else f"s{i % 4}" for i in range(n)],
            "n_chars": [len(t or "") for t in body],
        }
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [tuple(None if v is None or v != v else v for v in r) for r in documents.astype(object).itertuples(index=False)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, PASSAGE), (2, " ".join(BASE.split()[30:50])), (3, "two words"), (4, None), (5, "..."), (6, prose(14, 99)), (2, " ".join(BASE.split()[30:50]))]


def sql(query, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    cur = con.execute(query)
    return sorted((tuple(r) for r in cur.fetchall()), key=str), [c[0] for c in cur.description]


def agree(df, query, **tables):
    want, names = sql(query, **tables)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=str)
    assert got == want


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def clashing(docs):
    """Extra columns with the names that the operators use themselves."""
    for name in ("anchor", "low", "high", "one", "two", "bucket", "node", "component", "term", "pos", "start", "at", "block", "n", "begin", "a", "b"):
        docs = docs.withColumn(name, docs.doc_id * 2)
    return docs


# --- against SQL


def test_substring_dedup_sql(docs, documents):
    agree(substring_dedup.report(docs), queries.OP2_SQL, documents=documents)


def test_near_dedup_sql(docs, documents):
    agree(near_dedup.near_groups(docs), queries.OP4_SQL, documents=documents)


def test_decontamination_sql(spark, docs, documents):
    bench = pd.DataFrame(ITEMS, columns=["item_id", "text"])
    agree(decontamination.report(docs, items(spark, ITEMS)), queries.OP6_SQL, documents=documents, benchmark=bench)


def test_licence_scan_sql(spark):
    known = {(lic, kind): t for lic, kind, t in licence_scan.TEMPLATES}
    gpl = known[("GPL-3.0", "full text")]
    rows = [
        (1, "x y z\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the mit license"), (3, None), (4, ""),
        (5, known[("MIT", "text")]), (6, "a\n\n" + known[("BSD-3-Clause", "text")].replace(". ", ".\n") + "\n\nb"), (7, "word"), (2, "Released under the mit license"),
        (8, "Released under the MIT License. " * 200), (9, f"{prose(30, 1)} Released under the MIT License. {prose(25, 2)} Licensed under CC BY-NC 4.0. {prose(9, 3)}"),
        (10, f"{prose(40, 4)}\n\n{gpl}"), (11, gpl.replace("\n", " ")), (12, known[("Apache-2.0", "full text")].replace("License", "Licence", 20)), (13, prose(9000, 5)), (14, known[("Unlicense", "text")]),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("licence", F.lit("x"))
    got = {(r.doc_id, r.kind, r.line, r.word): r.licence for r in licence_scan.matches(frame).collect()}
    assert got[(1, "line", 1, 0)] == "Apache-2.0" and got[(2, "line", 0, 0)] == "MIT" and got[(5, "line", 0, 0)] == "MIT"
    assert got[(6, "paragraph", 2, 0)] == "BSD-3-Clause" and got[(8, "line", 0, 0)] == "MIT"
    assert got[(9, "stretch", 0, 30)] == "MIT" and got[(9, "stretch", 0, 60)] == "CC-BY-NC-4.0"  # notices within a line
    assert got[(10, "text", 0, 0)] == "GPL-3.0" and got[(11, "line", 0, 0)] == "GPL-3.0" and got[(12, "text", 0, 0)] == "Apache-2.0"
    assert got[(14, "line", 0, 0)] == "Unlicense" and not any(k[0] == 13 for k in got)
    agree(licence_scan.matches(frame), queries.OP8_SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert licence_scan.matches(frame).where("doc_id = 2 AND kind = 'line'").count() == 2  # equal rows are reported each
    assert licence_scan.matches(empty(spark, "doc_id long, text string")).count() == 0


def test_chat_format(spark):
    rows = [(c, t, r, f"m{c}{t}{r}") for c in (1, 2) for t, r in enumerate(["system", "ann", "bob", "ann", "cid"])]
    rows += [(3, 0, "ann", None), (3, 0, "ann", ""), (3, None, None, "who"), (4, 0, "system", "alone"), (None, 1, "bob", "hm")]
    rows += [(5, t, ("ann", "bob")[t % 2], "x" * (t % 9)) for t in range(300)]
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(rows, schema)
    got = chat_format.perspectives(frame)
    whole = {(r.conv_id, r.perspective): r for r in chat_format.dialogues(got).collect()}
    assert set(whole) == {(c, s) for c in (1, 2) for s in ("ann", "bob", "cid")} | {(3, "ann"), (None, "bob"), (5, "ann"), (5, "bob")}
    for key, r in whole.items():
        assert len(r.masks) == sum(1 for x in rows if x[0] == key[0] and x[2] == key[1])
        assert all(r.text[: m.begin].endswith("<|im_start|>assistant\n") and r.text[: m.end].endswith("<|im_end|>\n") for m in r.masks)
    assert whole[(1, "ann")].text.startswith("<|im_start|>system\nm10system<|im_end|>\n<|im_start|>assistant\nm11ann<|im_end|>\n<|im_start|>user name=bob\n")
    assert "<|im_start|>user name=unknown\nwho" in whole[(3, "ann")].text
    plain = [r for r in rows if r[0] in (1, 2, 5)]
    agree(chat_format.perspectives(spark.createDataFrame(plain, schema)), queries.OP7_SQL, conversations=pd.DataFrame(plain, columns=schema.replace(",", "").split()[::2]))
    assert chat_format.perspectives(empty(spark, schema)).count() == 0


def test_metric_search(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 1100)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2004, []), (2100, [2.0]), (None, [1.0]), (700, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in metric_search.top_k(frame).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    good = {i: [math.floor(1024 * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    assert set(got) == {i for i in good if i % 100 == 0}
    for q, found in got.items():
        score = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:10]
        assert [found[k + 1] for k in range(10)] == [(i, -s) for s, i in score]
    assert metric_search.top_k(empty(spark, "vec_id long, embedding array<double>")).count() == 0
    large = [(0, [3e5, -1.0]), (100, [-2e5, 4e4]), (200, [1.0, 2.0])]  # products beyond what doubles hold exactly
    good = {i: [math.floor(1024 * c) for c in v] for i, v in large}
    for x in metric_search.top_k(spark.createDataFrame([*large, *[(i, [float(i), 1e5]) for i in range(1, 60)]], "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(2))).collect():
        other = good.get(x.vec_id, [1024 * x.vec_id, 102_400_000])
        assert x.score == sum(a * b for a, b in zip(good[x.query_id], other))
    with pytest.raises(ValueError, match="64 bits"):
        metric_search.top_k(spark.createDataFrame([(0, [1e200])], "vec_id long, embedding array<double>"))


def test_chunks_and_shards_do_not_change_results(spark, monkeypatch):
    r = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, [float(v) for v in r.normal(size=5)]) for i in range(900)], "vec_id long, embedding array<double>")
    want = sorted(metric_search.top_k(frame, "vec_id % 3 = 0", 4).collect())
    monkeypatch.setattr(metric_search, "SHARD_ROWS", 200)
    monkeypatch.setattr(metric_search, "QUERY_CHUNK", 70)
    assert sorted(metric_search.top_k(frame, "vec_id % 3 = 0", 4).collect()) == want and len(want) == 1200


def test_tree_saves_work_and_stays_exact():
    r = np.random.default_rng(4)
    x = np.rint(np.concatenate([c + r.normal(size=(400, 6)) for c in r.normal(size=(20, 6)) * 60]) * 20).astype(np.int64)
    tree = metric_search.MTree(np.arange(len(x)), x, 5)
    work = 0
    for q in x[::500]:
        found, n = tree.search(q, -1, 5)
        work += n
        assert [s for s, _ in found] == sorted((x @ q).tolist(), reverse=True)[:5]
    assert work < 0.5 * len(x) * len(x[::500])


# --- brute force


def remove_repeats(bodies, width):
    often = Counter(b[k : k + width] for b in bodies for k in range(len(b) - width + 1))
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if often[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [suffix_dedup.SHARD_CLASSES, 1, 3])
def test_suffix_dedup(spark, docs, documents, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "SHARD_CLASSES", crowd)  # 1: every mixed minimizer is split by radix, down to single strings
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect()}
    bodies = [(t or "").encode() for t in documents.text]
    assert got == dict(zip(documents.doc_id, remove_repeats(bodies, 400), strict=True))


def test_suffix_dedup_leaves_clean_texts_alone(spark):
    """Two letters by rule around a middle that both texts have: their sums of bytes agree, and no string of 400 bytes does."""
    r = random.Random(185)
    middle = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(256))
    there = "".join("Y-"[k.bit_count() & 1] for k in range(256))
    back = there.translate(str.maketrans("Y-", "-Y"))
    texts = [there + middle + back, back + middle + there]
    got = suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.orderBy("doc_id").collect()]
    assert got == list(remove_repeats([t.encode() for t in texts], 400)) and got[0][1] == 0


def test_suffix_array_against_sorting():
    r = np.random.default_rng(1)
    for trial in range(150):
        t = r.integers(1, int(r.integers(2, 7)), int(r.integers(1, 70)))
        t = np.tile(t[:3], 15) if trial % 5 == 0 else t
        t = np.r_[t, 0]
        sa = suffix_array.suffix_array(t)
        flat = t.tolist()
        assert sa.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
        before, common = suffix_array.permuted_common_prefixes(t, sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            k = 0
            while max(i, j) + k < len(flat) and flat[i + k] == flat[j + k]:
                k += 1
            assert before[i] == j and common[i] == k


def test_suffix_array_costs_a_few_sorts():
    """Of near copies, as shards have them: induced sorting by blocks took 22 to 30 times the CPU seconds of one plain sort, doubling takes 6 to 9."""
    r = np.random.default_rng(3)
    words = [r.integers(97, 123, n) for n in r.integers(2, 8, 400)]
    text = np.concatenate([words[k] for k in r.integers(0, 400, 20000)])
    parts = [text[a : a + 700].copy() for a in r.integers(0, 60000, 150)]
    for p in parts:
        p[r.integers(0, 700, 3)] = 48
    t = np.concatenate([*(np.r_[p + len(parts) + 1, k + 1] for k, p in enumerate(parts)), [0]]).astype(np.int32)
    numbers = r.integers(0, 1 << 62, len(t))

    def seconds(f, x):
        begin = time.process_time()
        f(x)
        return time.process_time() - begin

    pairs = [(seconds(suffix_array.suffix_array, t), seconds(np.argsort, numbers)) for _ in range(9)]
    assert min(a for a, _ in pairs) < 14 * min(b for _, b in pairs)


def test_shards_against_counting():
    r = random.Random(8)
    parts = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(6)]
    contents = [b"".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(25)]
    often = Counter(c[k : k + 30] for c in contents for k in range(len(c) - 29))
    for c, found in zip(contents, suffix_dedup.repeated_in_shard(contents, 30), strict=True):
        starts = {k for a, b in found for k in range(a, b)}
        assert starts == {k for k in range(len(c) - 29) if often[c[k : k + 30]] > 1}


def test_mixing(docs, documents):
    rows = {r.doc_id: r for r in mixing.mixture_report(docs).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(documents.doc_id, documents.text)}
    assert {i: r["size"] for i, r in rows.items()} == size
    source = dict(zip(documents.doc_id, documents.source))
    names = sorted({s for s in source.values() if s is not None}) + [None]
    whole = {s: sum(v for i, v in size.items() if source[i] == s) for s in names}
    weight = {s: float(1 + k % 3) for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # share by weight, cap, share the rest again
        left = sum(whole.values()) - sum(3 * whole[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * whole[s] if s in capped else level * weight[s] for s in names}
        over = {s for s in names if target[s] > 3 * whole[s]}
        if not over:
            break
        capped |= over
    for i, r in rows.items():
        assert r.target == pytest.approx(target[source[i]]) and r.source_size == whole[source[i]] and r.taken <= 3 * r["size"]
    for s in names:
        taken = sum(r.taken for i, r in rows.items() if source[i] == s)
        assert taken == pytest.approx(target[s], rel=0.03, abs=60)
    assert {r.doc_id: r.taken for r in mixing.mixture_report(docs.repartition(2)).collect()} == {i: r.taken for i, r in rows.items()}


def test_mixture_is_even_along_the_way(docs):
    numbered, targets = mixing.prepared(docs)
    slots = mixing.schedule(mixing.block_plan(targets)).toPandas().fillna({"source": "none"})
    plan = mixing.block_plan(targets).toPandas().fillna({"source": "none"}).set_index("source")
    n = slots.slot.max() + 1
    for part in (0.25, 0.5, 0.75):
        early = slots[slots.slot < part * n].groupby("source").size()
        for s, row in plan.iterrows():
            assert abs(early.get(s, 0) - part * row.slots) < 6 + 0.02 * row.slots


def page(body, n=0):
    return f"<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav>{body}<footer>&copy; {n}</footer></body></html>"


def test_html_extraction(spark):
    rows = [(0, "http://a.example/0", None), (1, "http://a.example/1", ""), (2, None, page("<article><h1>T &amp; U</h1><p>a <b>b</b>c<br>d<p>e</article>"))]
    rows += [(10 + k, f"https://u@b.example:80/{k}", page(f"<div><span>Our site</span> says hello</div><div><p>Story {k}</p></div>", k)) for k in range(8)]
    rows += [(30, "http://c.example/", page("<article><p>x</p><div class='share-bar'>Share</div><section id=comments><p>me too</p></section><form>f</form></article>"))]
    rows += [(31, "http://c.example/2", "no tags at all &lt;really&gt;"), (31, "http://c.example/2", "no tags at all &lt;really&gt;")]
    got = html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("subtree", F.lit(1))).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[0] == text[1] == "" and text[2] == "T & U\na bc d\ne"
    assert [text[10 + k] for k in range(8)] == [f"Story {k}" for k in range(8)]  # the greeting is the site's template
    assert text[30] == "x" and text[31] == "no tags at all <really>"
    assert html_extraction.report(empty(spark, "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("source", ["<p", "<", "</p></p>", "<div><p>a</div>b", "<a href='>'>x</a>", "<!-- x", "<script>", "<li>a<li>b<ul><li>c</ul>", "&#x110000;&#0;", "<" * 2000])
def test_broken_pages(source):
    page_tree.article_blocks(page_tree.read(source))


def test_deep_pages():
    source = "<div>" * 5000 + "x" + "</div>" * 5000
    assert page_tree.article_blocks(page_tree.read(source))[0] == ["x"]


N = 100_000
HARD = {
    "open tags": "<a " * 10**6, "open quotes": "<a '" * N, "one quote": '<a b="x>' * N + "'", "nested": "<div>" * N + "x" + "</div>" * N,
    "articles": "<article><p>x</p></article>" * N, "stray ends": "<i><div>" + "<b>" * N + "</i>" * N, "rules": "<b>" * N + "<hr>" * N,
    "items": "<div>" * N + "<li></li>" * N, "raw": "<script>" + "</script " * N, "comments": "<!--" * N, "signs": "<" * 10**6,
    "declarations": "<!x" * N, "classes": "<p " + 'class="' * N + ">x", "nested articles": "<article>" * N,
}


@pytest.mark.parametrize("name", HARD)
def test_reading_is_linear(name):
    """Work follows the length: a quadratic reader would take hours for these."""
    start = time.perf_counter()
    page_tree.article_blocks(page_tree.read(HARD[name]))
    assert time.perf_counter() - start < 20


class _Plain(HTMLParser):
    """Text of a page by a plain parser: blocks are split at block tags, marked elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.line, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.cut(tag)
        self.skip += self.skip > 0 or tag in ("nav", "footer", "script") if tag not in page_tree.VOID else 0

    def handle_endtag(self, tag):
        self.cut(tag)
        self.skip -= self.skip > 0

    def cut(self, tag):
        if tag in page_tree.BLOCK:
            self.close_line()
        elif tag == "br" and not self.skip:
            self.line.append(" ")

    def close_line(self):
        text = " ".join("".join(self.line).split())
        self.blocks += [text] if text else []
        self.line = []

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def test_small_pages_against_a_plain_parser():
    r = random.Random(12)

    def element(depth):
        kind = r.randrange(8)
        if kind < 3 or depth > 4:
            return r.choice(["a b", "x &amp; y", "&eacute;t&eacute;", " ", "1 &lt; 2", "\n t ", "&#8364;"])
        if kind == 3:
            return r.choice(["<br>", "<hr>", "<img alt='>'>", "<!-- <p> -->", "<script>'</p>' < 1</script>"])
        tag = r.choice(["div", "section", "b", "a", "ul", "blockquote", "nav", "footer", "em"])
        attributes = r.choice(["", " title='a > b'", ' data-x="1"', " lang=en"])
        return f"<{tag}{attributes}>{''.join(element(depth + 1) for _ in range(r.randrange(4)))}</{tag}>"

    for _ in range(400):
        source = "<html><body>" + "".join(element(0) for _ in range(6)) + "</body></html>"
        plain = _Plain()
        plain.feed(source)
        plain.close()
        plain.close_line()
        assert page_tree.article_blocks(page_tree.read(source))[0] == plain.blocks, source


def test_templates_alone_decide_where_menus_change(spark):
    """Nothing is marked: only what a host does on its pages tells menu, advert and footer from the text."""
    r = random.Random(2)
    rows = []
    for k in range(12):
        menu = "".join(f"<div><a href='/{r.randrange(999)}'>{prose(2, 1000 * k + i)}</a></div>" for i in range(5))
        text = "".join(f"<p>{prose(40, 7000 + 10 * k + i)}</p>" for i in range(r.randint(1, 4)))
        body = f"<div class=one><table><tr><td>{menu}</td></tr></table></div><div class=two><div>{text}</div></div><div class=three>{prose(6, 50 + k)}</div>"
        rows.append((k, f"http://menus.example/{k}", f"<html><body>{body}</body></html>"))
    rows += [(100 + k, f"http://few.example/{k}", rows[k][2]) for k in range(3)]  # too few pages to tell
    got = {g.page_id: g for g in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        want = [w.split("</p>")[0] for w in rows[k][2].split("<p>")[1:]]
        assert got[k].text.split("\n") == want and got[k].rule == "templates"
    assert all(got[100 + k].rule == "marks" and len(got[100 + k].text) > len(got[k].text) for k in range(3))


def test_language_id(spark):
    alphabets = {"en": "abcdefgh", "fr": "ijklmnop", "de": "qrstuvwx"}
    r = random.Random(2)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word(alphabets[lang]) for _ in range(30)), lang) for i in range(150) for lang in (list(alphabets)[i % 3],)]
    rows += [(900, None, "en"), (901, "123 -- 4", "en"), (902, "", None), (None, rows[0][1], "en"), (0, rows[0][1], "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.report(frame).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    truth = {i: lang for i, _, lang in rows[:150]}
    held = [x for x in got if x.doc_id in truth and x.held_out]
    assert len(held) > 20 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert all(x.lang_pred == "und" for x in got if x.doc_id in (900, 901, 902))
    assert [x.held_out for x in got if x.doc_id is None] == [False]
    assert language_id.report(empty(spark, "doc_id long, text string, lang string")).count() == 0
    assert {x.lang_pred for x in language_id.report(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    again = {(x.doc_id, x.score) for x in language_id.report(frame.repartition(5)).collect()}
    assert again == {(x.doc_id, x.score) for x in got}


def test_temperature_recovers_a_known_scale():
    r = np.random.default_rng(0)
    scores = r.normal(size=(4000, 3)) * 2
    labels = np.array([r.choice(3, p=p) for p in language_id.softmax(scores / 1.7)])
    assert language_id.temperature(scores, labels) == pytest.approx(1.7, rel=0.1)


# --- odd rows, whatever the operator


OPERATORS = {
    "mixing": lambda spark, d: mixing.mixture_report(d),
    "substring": lambda spark, d: substring_dedup.report(d),
    "near": lambda spark, d: near_dedup.near_groups(d),
    "suffix": lambda spark, d: suffix_dedup.report(d),
    "decontamination": lambda spark, d: decontamination.report(d, items(spark, ITEMS)),
    "language": lambda spark, d: language_id.report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_null_ids_and_clashing_names(spark, docs, name):
    some = clashing(docs.where("length(text) < 5000 OR text IS NULL"))
    odd = some.union(some.where("doc_id % 3 = 0")).union(some.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    assert OPERATORS[name](spark, odd).count() == odd.count()


def test_filters_keep_columns(spark, docs):
    some = clashing(docs.where("length(text) < 5000"))
    for kept in (
        near_dedup.deduplicated(some), substring_dedup.deduplicated(some), decontamination.decontaminated(some, items(spark, ITEMS)), language_id.accepted(some),
    ):
        assert kept.columns == some.columns and 0 < kept.count() <= some.count()
    assert decontamination.decontaminated(some, items(spark, [])).count() == some.count()


def test_proximity(spark):
    frame = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 40 + "beta gamma"), (4, None)], "doc_id long, text string")
    found = decontamination.proximity_matches(frame, items(spark, [(7, "alpha beta gamma")]), reach=6).select("doc_id").distinct().collect()
    assert {r.doc_id for r in found} == {1, 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_circulant_signature_estimates_jaccard():
    r = np.random.default_rng(6)
    pool = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = np.concatenate([pool[:1000], pool[200:1200]])
    signs = near_dedup.circulant_signature(sets, np.array([0, 1000]), 512)
    assert (signs[:, 0] == signs[:, 1]).mean() == pytest.approx(800 / 1200, abs=0.08)


def test_cover_is_checked(docs):
    with pytest.raises(ValueError):
        substring_dedup.removals(docs, cover=(0, 1))


def test_arrow_slices_cover_all_rows():
    from barloom.llm.wordtools import Words, slices

    body = ["a b", None, "", "c" * 50, " d\te\n"] * 7
    batch = pa.record_batch({"text": pa.array(body)})
    parts = list(slices(batch, "text", limit=20))
    assert sum(len(p) for p in parts) == len(body)
    assert [int(n) for p in parts for n in Words(p.column("text")).counts] == [2, 0, 0, 1, 2] * 7
