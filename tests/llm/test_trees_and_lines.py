"""Line dedup, Merkle manifest and prefix trie: brute force, SQL, odd rows, and many small blocks and partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import line_dedup, merkle_manifest, ordered_runs, prefix_trie, queries, substring_dedup, near_dedup
from barloom.llm.wordtools import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rows = [None, "", "\n", "\n\n \n", " \t Common line \r", "common LINE", "COMMON line\nown 1", "ÀB common ", "x" * 200_000]
    rows += [f"Common line\nrow {i % 7}\n  shared by some {i // 4}\nShared By Many\x0b\n{'a long one ' * i}" for i in range(30)]
    rows += ["common line\n" * 300 + "tail", "Shared by many", "shared by many\nshared by many", "Éa common\nÉA COMMON"]
    return rows


@pytest.fixture(scope="module")
def documents():
    body = texts()
    n = len(body)
    rows = [(i + 5, t, (None, "en", "fr", "", "en")[i % 5], None if i % 4 == 0 else f"s{i % 3}", i or None) for i, t in enumerate(body)]
    rows += [(None, "Common line\nno id", "en", None, None), rows[10], rows[10], (7, "another\ncommon line", "fr", "s", 3), (10**12, None, None, None, None)]
    assert n < len(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(5)


def same(got, sql, spark_table, view):
    """Both engines' rows, order aside."""
    con = duckdb.connect()
    con.register(view, spark_table.toArrow())
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)


def line_truth(rows, documents=10, length=1, keep="none"):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    owners = defaultdict(set)
    split = [[(line, line.strip(blanks).translate(lower)) for line in (r[1] or "").split("\n")] for r in rows]
    for r, lines in zip(rows, split):
        for _, key in lines:
            if len(key) >= length and r[0] is not None:
                owners[key].add(r[0])
    common = {k: min(v) for k, v in owners.items() if len(v) >= documents}
    out = []
    for r, lines in zip(rows, split):
        spared, kept = set(), []
        for line, key in lines:
            first = keep == "first" and common.get(key) == r[0] and key not in spared
            if key not in common or first:
                kept.append(line)
                spared.add(key)
        out.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("minimum", "length", "keep"), [(10, 1, "none"), (2, 1, "none"), (2, 8, "first"), (10, 1, "first"), (31, 1, "none")])
def test_line_dedup(docs, documents, minimum, length, keep):
    done = line_dedup.line_dedup(docs, minimum, length, keep)
    got = done.select("doc_id", "_dedup_lines", "_dedup_dropped", "_dedup_sha256").collect()
    assert sorted(map(tuple, got), key=str) == line_truth(documents, minimum, length, keep)


def test_line_dedup_sql_and_filter(spark, docs):
    same(queries.line_dedup.report(docs), queries.OP13_SQL, docs, "documents")
    kept = line_dedup.deduplicated(docs.withColumn("key", F.lit("k")).withColumn("docs", F.lit(1)), 10)
    assert kept.columns == [*docs.columns, "key", "docs"] and kept.count() == docs.count()
    assert kept.where("doc_id = 5").first().text is None
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_filters_of_many_segments(spark, docs, documents, monkeypatch):
    """Small, crowded filters suspect more keys; the exact count decides all the same."""
    monkeypatch.setattr(line_dedup, "SEGMENT", 256)
    monkeypatch.setattr(line_dedup, "SLICE", 500)
    got = line_dedup.line_dedup(docs, 3).select("doc_id", "_dedup_lines", "_dedup_dropped", "_dedup_sha256").collect()
    assert sorted(map(tuple, got), key=str) == line_truth(documents, 3)


def test_filters():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    filters = line_dedup.Filters()
    filters.add(keys[:30_000], np.zeros(30_000, dtype=bool))
    filters.add(keys[29_000:59_000], np.zeros(30_000, dtype=bool))
    filters.add(keys[59_000:], np.ones(1_000, dtype=bool))
    assert filters.seen_again(keys[29_000:30_000]).all() and filters.seen_again(keys[59_000:]).all()
    assert filters.seen_again(keys[:29_000]).mean() < 0.02


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordered_runs(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(3)
    rows = [("hot", r.randrange(10**6), "a") for _ in range(3000)] + [(None, i, "b") for i in range(20)] + [(f"k{i}", 1, "c") for i in range(300)]
    rows += [("hot", None, "d")]
    df = spark.createDataFrame(rows, "k string, v long, pos_ string").repartition(4)
    product = ordered_runs.Product("pos_", lambda s: s.encode(), b"", lambda a, n, b: a + b)
    got = ordered_runs.ordered_runs(df, "k", ["v"], "t", product).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for k, part in got.groupby("k", dropna=False):
        part = part.sort_values("pos")
        assert part["pos"].tolist() == list(range(1, len(part) + 1))
        values = part["v"].tolist()
        if k == "hot":
            assert np.isnan(values[0]) and values[1:] == sorted(values[1:])
            assert bytes(part["mark"].iloc[-1]) == b"d" + b"a" * 3000


def merkle_truth(rows, fan=8):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            run = nodes[i // fan * fan : i // fan * fan + fan]
            yield i % fan, run[: i % fan], run[i % fan + 1 :]
            i //= fan

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups = defaultdict(list)
    for r in rows:
        other = r[1]
        if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            other = r[1].translate(lower)
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, other), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    root = top[-1][0] if names else None
    out = []
    for gi, g in enumerate(names):
        for i, (_, _, own, other, doc) in enumerate(sorted(groups[g])):
            node, proof = other, ""
            for _, left, right in [*way(trees[g], i), *way(top, gi)]:
                node, proof = sha("".join([*left, node, *right])), proof + "".join(left + right)
            out.append((doc, own, trees[g][-1][0], root, sha(proof), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fan", "levels"), [(8, 4), (8, 1), (2, 2), (3, 1)])
def test_merkle_manifest(docs, documents, fan, levels):
    got = merkle_manifest.report(docs, fan, levels)
    assert sorted(map(tuple, got.collect()), key=str) == merkle_truth(documents, fan)


def test_merkle_sql(docs):
    same(merkle_manifest.report(docs), queries.OP11_SQL, docs, "documents")


def test_merkle_odd_tables(spark, docs):
    assert merkle_manifest.report(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 9")
    got = merkle_manifest.report(one).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("")
    clash = docs.withColumn("grp", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("leaf", F.lit("x"))
    assert sorted(merkle_manifest.report(clash).collect(), key=str) == sorted(merkle_manifest.report(docs).collect(), key=str)


@pytest.mark.parametrize(("levels", "fan"), [(1, 8), (2, 8), (3, 2), (5, 8), (6, 3)])
def test_addresses(levels, fan):
    at = merkle_manifest.addresses(levels, fan)
    assert [len(a) for a in at] == [fan**d for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range(sum(len(a) for a in at)))
    top = levels // 2
    if top:  # the top half comes first, each bottom tree is one stretch
        assert max(a.max() for a in at[:top]) == sum(fan**d for d in range(top)) - 1
        size = sum(fan**d for d in range(levels - top))
        for i, start in enumerate(at[top]):
            below = np.concatenate([at[top + d][i * fan**d : (i + 1) * fan**d] for d in range(levels - top)])
            assert below.min() == start and below.max() == start + size - 1


def test_proof_columns(docs, documents):
    m = merkle_manifest.document_manifest(docs, 2, 2)
    for r in merkle_manifest.proofs(m, ["doc_id"], "tampered", True, 2, 2).collect():
        node = r.leaf
        for step in r.proof:
            others = [bytes(step["others"])[i : i + 32].hex() for i in range(0, len(step["others"]), 32)]
            node = sha("".join([*others[: step["place"]], node, *others[step["place"] :]]))
        assert node == r.root


def trie_truth(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    given = {c: [t[3] for t in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(given.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
    out = []
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(s))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(kids[s]), leaves[s], saved[s], sha(ends)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(8)
    lines = ["Hi", "How?", "Well é", "", None, "long " * 50]
    rows = []
    for c in [*range(-7, 60), 1000, 1004, 10**15 + 3]:
        for t in range(r.randrange(1, 14)):
            rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(lines[:3] if t < 6 else lines)))
    rows += [(c, t, "user", "same") for c in range(60, 95) for t in range(12)]  # copies
    rows += [(200, t, "user", f"turn {t % 40}") for t in range(420)] + [(201, t, "user", f"turn {t % 40}") for t in range(350)]
    rows += [(203, 1, "a", "tie"), (203, 1, "b", "tie"), (203, 1, "a", "tie"), (None, 1, "user", "x"), (300, None, None, None)]
    return rows


def test_prefix_trie(spark, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 64)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    df = spark.createDataFrame(conversations, TURNS).repartition(5).withColumn("pos", F.lit(1)).withColumn("conv", F.lit("x"))
    got = prefix_trie.report(df)
    assert sorted(map(tuple, got.collect()), key=str) == trie_truth(conversations)


def test_prefix_trie_sql(spark, conversations):
    rows = [r for r in conversations if r[0] not in (200, 201)]
    df = spark.createDataFrame(rows, TURNS)
    same(prefix_trie.report(df), queries.OP12_SQL, df, "conversations")
    assert prefix_trie.report(df.limit(0)).count() == 0


def test_fingerprints_compose():
    r = random.Random(4)
    turns = [bytes(r.randrange(256) for _ in range(32)) for _ in range(40)]

    def of(some):
        mark = prefix_trie.EMPTY
        for t in some:
            mark = prefix_trie.combine(mark, 1, prefix_trie._element(t).to_bytes(16, "big"))
        return mark

    for i in range(40):
        assert prefix_trie.combine(of(turns[:i]), 40 - i, of(turns[i:])) == of(turns)
        joined = of(turns[5:9] + turns[i:])
        assert prefix_trie.extended(of(turns[5:9]), of(turns[:i]), 40 - i, of(turns)) == prefix_trie._number(joined)


def thue_morse(n):
    bits = "".join(str(bin(i).count("1") % 2) for i in range(n))
    return bits.translate(str.maketrans("01", "ab")), bits.translate(str.maketrans("01", "ba"))


def test_long_words_of_two_letters(spark):
    """Sums of powers modulo 2**64 make such words equal."""
    one, two = thue_morse(1024)
    import pyarrow as pa

    assert len(set(Words(pa.array([one, two, one])).hashes().tolist())) == 2
    rows = [(i, " ".join([word] * 13)) for i, word in enumerate((one, two, one), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.report(df).collect()} == {1: 0, 2: 0, 3: 13}
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_fold_and_differ():
    import pyarrow as pa

    r = random.Random(6)
    words = ["".join(r.choice("abAB") for _ in range(r.randrange(1, 90))) for _ in range(5000)]
    for lower, fold in ((False, str), (True, str.lower)):
        h = Words(pa.array([" ".join(words)])).hashes(lower)
        assert pd.Series(h).groupby([fold(w) for w in words]).nunique().max() == 1
        assert len(set(h.tolist())) == len({fold(w) for w in words})
    assert not np.isin(Words(pa.array(words)).hashes(salt=1), Words(pa.array(words)).hashes()).any()
