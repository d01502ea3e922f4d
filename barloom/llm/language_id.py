"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: runs of 1 to 3 letters (other characters count as one blank), hashed to ``FEATURES`` columns, weighted
``(1 + ln tf) * idf`` and scaled to length one.  Document frequencies come from every training document's whole text.  The
weights are learned with follow-the-regularised-leader steps (elastic net: ``L1`` and ``L2``) on a balanced sample of at most
about ``SAMPLE`` labelled documents, in one task; a fifth of the sample sets the softmax temperature.  The model, at most
``FEATURES`` rows of one weight a language, is sent to every task, which reads whole texts.

Training documents: label and ``doc_id`` not null, ``crc32(doc_id as text) % 3 <> 1``.

Defined results: ``und`` with score 0 for a null text, one without a letter, and if there was nothing to learn from; equal
texts get equal results whatever their other columns; ties go to the first language in code point order; other columns pass
through ``identified`` unless they begin with ``_lang``; the filter ``accepted`` keeps all documents, unjudged, if there was
nothing to learn from; more than ``LANGUAGES`` labels are an error, since the model has a weight for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.steps import per_batch
from barloom.llm.wordtools import slices, text_bytes
from barloom.plans.staging import ship_package

FEATURES = 1 << 14
SIZES = (1, 2, 3)
SAMPLE = 3000  # labelled documents of the fit, in equal parts by language
EPOCHS = 3
LANGUAGES = 512
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"
ACCEPT = 0.5  # the filter keeps documents at or above this score

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x ^ (x >> np.uint32(13))) & np.uint32(FEATURES - 1)


def gram_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Per row: the feature columns it has and how often; nothing for a row without a letter."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.cumsum(np.asarray(pc.utf8_length(texts)))
    code = np.frombuffer(text_bytes(texts)[0].tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    letter = _is_letter()[code]
    code = np.where(letter, code, np.uint32(0x20))
    count = np.r_[0, np.cumsum(letter)]
    grams, begin = [], 0
    for n in SIZES:
        h = np.full(max(0, len(code) - n + 1), n, dtype=np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + code[k : k + len(h)]
        grams.append(_spread(h))
    for end in ends.tolist():
        if count[end] == count[begin]:
            yield None
        else:
            found = np.bincount(np.concatenate([g[begin : max(begin, end - n + 1)] for n, g in zip(SIZES, grams, strict=True)]), minlength=FEATURES)
            columns = np.flatnonzero(found)
            yield columns, found[columns]
        begin = end


def _vector(columns: np.ndarray, often: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(often)) * idf[columns]
    return x / math.sqrt(float(x @ x))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("lang IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), 3) <> 1").select("doc_id", "text", "lang")


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each column over the whole texts of ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches):
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for found in gram_counts(part.column("text")):
                    if found is not None:
                        total[found[0]] += 1
                        rows += 1
        some = np.flatnonzero(total)
        yield pa.record_batch({"feature": np.r_[some, -1], "often": np.r_[total[some], rows]})

    sums = docs.select("text").mapInArrow(run, "feature long, often long").groupBy("feature").agg(F.sum("often").alias("often"))
    often = np.zeros(FEATURES + 1)
    for row in sums.collect():  # at most FEATURES + 1 rows
        often[row.feature] = row.often
    return np.log((1 + often[-1]) / (1 + often[:-1])) + 1


class FollowTheLeader:
    """FTRL-proximal multinomial logistic regression; the weights are a function of the sums ``z`` and ``n``."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, columns=slice(None)) -> np.ndarray:
        z, n = self.z[columns], self.n[columns]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, columns: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(columns)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        grown = self.n[columns] + g * g
        self.z[columns] += g - (np.sqrt(grown) - np.sqrt(self.n[columns])) / self.alpha * w
        self.n[columns] = grown


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(scores / math.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, g = -1.0, 4.0, (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(docs: DataFrame, idf: np.ndarray, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights ``(FEATURES, languages)`` and temperature."""
    found = docs.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    counts = dict(sorted((r.lang, r["count"]) for r in found))
    langs = list(counts)
    if not langs:
        return [], np.zeros((FEATURES, 0)), 1.0
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample / len(langs) / n))])
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = docs.where(F.pmod(order, F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    chosen = chosen.select("doc_id", "text", "lang", order.alias("_order"))

    def run(batches):
        rows = []
        for batch in batches:
            for part in slices(batch, "text"):
                info = zip(part.column("_order").to_pylist(), part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), strict=True)
                for key, found in zip(info, gram_counts(part.column("text")), strict=True):
                    if found is not None:
                        rows.append((key, found[0].astype(np.uint16), _vector(*found, idf).astype(np.float32)))
        rows.sort(key=lambda r: r[0])
        held = [k for k in range(len(rows)) if k % 5 == 4]
        model, place = FollowTheLeader(len(langs)), {lang: k for k, lang in enumerate(langs)}
        for epoch in range(epochs):
            for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
                if k % 5 != 4:
                    (_, _, lang), columns, x = rows[k]
                    model.learn(columns.astype(np.int64), x.astype(np.float64), place[lang])
        w = model.weights()
        scores = np.array([rows[k][2].astype(np.float64) @ w[rows[k][1].astype(np.int64)] for k in held]).reshape(-1, len(langs))
        heat = temperature(scores, np.array([place[rows[k][0][2]] for k in held], dtype=np.int64))
        yield pa.record_batch({"w": pa.array([w.astype(np.float64).tobytes()], pa.binary()), "heat": pa.array([heat])})

    ship_package(docs.sparkSession)
    row = chosen.repartition(1).mapInArrow(run, "w binary, heat double").first()  # one bounded model
    return langs, np.frombuffer(row.w, dtype=np.float64).reshape(FEATURES, -1).copy(), row.heat


def learned(docs: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, float]:
    """Inverse frequencies, languages, weights and temperature from the training documents of ``docs``."""
    train = training_rows(docs)
    idf = inverse_frequencies(train)
    return idf, *fit(train, idf)


def identified(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray, float] | None = None) -> DataFrame:
    """``docs`` with ``_lang_pred``, ``_lang_score`` and ``_lang_held_out``, by a ``model`` of ``learned`` or one of ``docs``."""
    idf, langs, weights, heat = model or learned(docs)
    model = docs.sparkSession.sparkContext.broadcast((idf, weights))
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("_lang_pred string, _lang_score double").fields)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idf, weights = model.value
        for part in slices(batch, "text"):
            names, scores = [], []
            for found in gram_counts(part.column("text")):
                if found is None or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = softmax(_vector(*found, idf) @ weights[found[0]] / heat)
                    best = int(p.argmax())
                    names.append(langs[best])
                    scores.append(float(p[best]))
            yield pa.record_batch([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id AS string)), 3) = 1"), F.lit(False))
    return per_batch(docs, work, schema).withColumn("_lang_held_out", held)


def report(docs: DataFrame) -> DataFrame:
    done = identified(docs.select("doc_id", "text", "lang"))
    return done.selectExpr("doc_id", "_lang_held_out AS held_out", "_lang_pred AS lang_pred", "_lang_score AS score")


def accepted(docs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """``docs`` without the documents whose language can't be told: no letter, or a score below ``least``.  Without a labelled
    document there is no model to judge by, and all stay."""
    model = learned(docs)
    if not model[1]:
        return docs
    done = identified(docs, model)
    return done.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select(docs.columns)
