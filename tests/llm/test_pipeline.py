"""The pipeline on a small table: planted cases stage by stage, odd rows, an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import language_id, near_dedup
from barloom.llm.steps import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(31)
# Two languages that share all letters and differ in how these follow each other.
SYLLABLES = {"aa": ["ba", "ce", "di", "fo", "gu"], "bb": ["ab", "ec", "id", "of", "ug"]}
WORDS = {lang: ["".join(r.choice(s) for _ in range(r.randint(2, 4))) for _ in range(600)] for lang, s in SYLLABLES.items()}


def prose(lang, n, seed):
    q = random.Random(seed)
    return " ".join(q.choice(WORDS[lang]) for _ in range(n))


PASSAGE, ITEM = prose("aa", 60, 900), prose("aa", 20, 901)


def rows():
    out = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        out.append((i, prose(lang, 80, i), lang, f"s{i % 3}" if i % 7 else None, 1))
    out += [(200, out[4][1], "aa", "s0", 1), (201, out[4][1] + " " + WORDS["aa"][0], "aa", "s1", 1)]  # copies of 4
    out += [(300 + i, f"{prose('aa', 40, 500 + i)} {PASSAGE} {prose('aa', 40, 600 + i)}", "aa", "s0", 1) for i in range(3)]
    out += [(400, ITEM, "aa", "s1", 1), (401, None, "aa", "s1", 1), (402, "12 34 ...", "aa", "s1", 1), (403, "", None, None, None)]
    out += [(None, prose("bb", 70, 950), "bb", "s2", 1), out[10], out[10], (11, prose("bb", 80, 960), "bb", "s0", 1)]  # 11 comes with two texts
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("i1", ITEM), (None, PASSAGE[:10]), ("i3", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_catch_what_is_planted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("bucket", F.lit("x")).withColumn("pos", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == before
        kept[name] = {}
        for x in docs.collect():
            kept[name].setdefault(x.doc_id, []).append(x.text)
    clean = set(range(160)) | {None}
    assert clean <= set(kept["language_id"]) and not {401, 402, 403} & set(kept["language_id"])
    near = kept["near_dedup"]
    assert clean <= set(near) and not {200, 201} & set(near) and all(len(v) == 1 for v in near.values())
    assert near[11] == [min(t for i, t, *_ in rows() if i == 11)]
    cut = kept["substring_dedup"]
    assert set(cut) == set(near) and PASSAGE in cut[300][0] and all(PASSAGE not in cut[i][0] and cut[i][0].startswith(near[i][0][:100]) for i in (301, 302))
    assert all(cut[i] == near[i] for i in clean)
    assert set(kept["decontamination"]) == set(cut) - {400}


def test_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len({x.doc_id for x in got}) == 160 + 1 + 3
    for source in {x.source for x in got}:
        some = [x for x in got if x.source == source]
        assert sum(x["size"] for x in some) == some[0].source_size
        assert abs(sum(x.taken for x in some) - some[0].target) <= max(60, 0.03 * some[0].target)
        assert all(0 <= x.taken <= 3 * x["size"] for x in some)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, got))


def test_empty_and_unlabelled_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.accepted(unlabelled).count() == docs.count()
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id())).where("doc_id < 40")
    with pytest.raises(ValueError, match="labels"):
        language_id.LANGUAGES, before = 5, language_id.LANGUAGES
        try:
            language_id.accepted(many)
        finally:
            language_id.LANGUAGES = before


def test_languages_that_share_letters(spark, folder):
    got = language_id.report(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 160]
    assert len(held) > 30 and sum(x.lang_pred == ("aa", "bb")[x.doc_id % 2] for x in held) >= 0.97 * len(held)


def test_repeated_rows_leave_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL")
    once, twice = near_dedup.deduplicated(docs), near_dedup.deduplicated(docs.union(docs))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
