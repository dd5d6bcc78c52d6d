"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties, on a bounded sample of labelled rows;
document frequencies are counted over all training rows. A temperature, fitted on rows of the sample that
the training leaves out, calibrates the probabilities. Prediction reads each text once, in any task.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, tune

#: Buckets of the hashed n-grams, and the lengths of the n-grams.
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
#: About this many labelled rows of each language are used to fit the weights; document frequencies use all of them.
SAMPLE_PER_LANGUAGE = 700
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.05, 0.02
#: Factor of the relative frequencies, so that the penalties have a usual scale.
SCALE = 10.0
#: What the calling stage of a pipeline takes as undecided.
LEAST_SCORE = 0.35

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numerals that count as word characters but are no letters by their Unicode category.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_AS_BLANKS = dict.fromkeys(map(ord, _NUMERALS), " ")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text's letters; words are lower-cased and parted by single spaces. No letters: empty."""
    if not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = text.translate(_AS_BLANKS)
    letters = _NOT_LETTERS.sub(" ", text).strip(" ").lower()
    if not letters:
        return np.zeros(0, dtype=np.int64)
    a = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, h = [], np.zeros(len(a), dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        h = (h[: len(a) - n + 1] + a[n - 1 :]) * _MIX[(n - 1) % 3]
        if n in LENGTHS and len(h):
            out.append(((h ^ (h >> np.uint32(15))) * _MIX[n % 3]) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """Weights by bucket and language, with the inverse document frequencies in them."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Calibrated probabilities by language; None if the text has no letter."""
        g = grams(text or "")
        if not len(g) or not self.languages:
            return None
        if len(g) > BUCKETS:
            total = np.bincount(g, minlength=BUCKETS).astype(np.float64) @ self.weights
        else:
            total = self.weights[g].sum(axis=0, dtype=np.float64)
        return softmax((total / len(g) + self.bias) / self.temperature)


    def decide(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; `und` and 0 if the text has no letter."""
        p = self.probabilities(text)
        return ("und", 0.0) if p is None else (self.languages[int(p.argmax())], float(p.max()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and the number of texts."""
    schema = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for t in b.column("t").to_pylist():
                df[np.unique(grams(t)) if len(t) < 4000 else np.flatnonzero(np.bincount(grams(t), minlength=BUCKETS))] += 1
                n += 1
        some = np.flatnonzero(df)
        yield batch(schema, bucket=np.append(some, BUCKETS).astype(np.int32), df=np.append(df[some], n))

    sums = rows.select("t").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow().to_pydict()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[sums["bucket"]] = sums["df"]
    return df[:BUCKETS], int(df[BUCKETS])


def fit(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows k, t, lang (text and label not null). Without rows the model knows no language."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    place = (F.xxhash64("k", F.lit("sample")) % 1_000_000 + 1_000_000) % 1_000_000
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n)))) if counts else F.lit(None)
    sample = rows.where(place < share[F.col("lang")] * 1_000_000) if counts else rows
    schema = pa.schema([("k", pa.int64()), ("lang", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(grams(t), return_counts=True) for t in b.column("t").to_pylist()]
            yield batch(schema, k=b.column("k"), lang=b.column("lang"), buckets=[x.astype(np.int32) for x, _ in found], counts=[(c / max(1, c.sum())).astype(np.float32) for _, c in found])

    got = sample.select("k", "lang", "t").mapInArrow(run, "k long, lang string, buckets array<int>, counts array<float>").toArrow().sort_by([("k", "ascending"), ("lang", "ascending")])
    y = [languages.index(x) for x in got.column("lang").to_pylist()]
    b, c = got.column("buckets").combine_chunks(), got.column("counts").combine_chunks()
    x = [(b[i].values.to_numpy(), c[i].values.to_numpy(zero_copy_only=False).astype(np.float64)) for i in range(len(y))]
    x = [(u, v * idf[u] * SCALE) for u, v in x]
    usable = [i for i in range(len(y)) if len(x[i][0])]
    order = np.random.default_rng(7).permutation(usable).astype(int)
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    w, bias = follow_the_leader([x[i] for i in train], [y[i] for i in train], len(languages))
    logits = np.array([v @ w[u] + bias for u, v in (x[i] for i in held)]).reshape(len(held), len(languages))
    return Model(languages, (w * (idf * SCALE)[:, None]).astype(np.float32), bias, temperature(logits, np.array([y[i] for i in held], dtype=int)))


def follow_the_leader(x: list[tuple[np.ndarray, np.ndarray]], y: list[int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2 penalties, one example at a time; bucket BUCKETS is the bias, which has no penalty."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    l1, l2 = np.full((BUCKETS + 1, 1), L1), np.full((BUCKETS + 1, 1), L2)
    l1[-1] = l2[-1] = 0

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(x)):
            u, v = np.append(x[i][0], BUCKETS), np.append(x[i][1], 1.0)
            w = weights(z[u], n[u], l1[u], l2[u])
            error = softmax(v @ w)
            error[y[i]] -= 1
            g = v[:, None] * error
            z[u] += g - (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / ALPHA * w
            n[u] += g * g
    w = weights(z, n, l1, l2)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(y)), y], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, lang_pred and score of each row; `und` with score 0 if the text is null or has no letter."""
    tune(docs.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.decide(t) for t in b.column("t").to_pylist()]
            yield batch(schema, k=b.column("k"), lang_pred=[x for x, _ in found], score=[s for _, s in found])

    return docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "k long, lang_pred string, score double")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether a row is in the fold that no learning may see; rows without a key are."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """k, t, lang of the labelled rows that are not held out."""
    return docs.where(~held_out(F.col(f"`{key}`"), folds, fold)).select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("lang")).where("t is not null and lang is not null")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """Train on the rows outside the fold and predict all rows: k, held_out, lang_pred, score.

    Repeated rows get equal predictions; a null key counts as held out. If no row has a label, every
    prediction is `und`.
    """
    tune(docs.sparkSession)
    model = fit(training_rows(docs, key, text, lang, folds, fold))
    return predict(docs, model, key, text).select("k", held_out(F.col("k"), folds, fold).alias("held_out"), "lang_pred", "score")


def decided(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs`, as they are, whose language is decided: the text has a letter and the score is `least` or more.

    Trains like `identify`. Each row is judged by its own text, so rows that repeat a key, or have none, stay
    or go by themselves. If no row has a label, all go; an empty table stays empty.
    """
    tune(docs.sparkSession)
    model = fit(training_rows(docs, key, text, lang, folds, fold))

    def sure(t: pa.Array) -> pa.Array:
        found = [model.decide(x) for x in t.to_pylist()]
        return pa.array([x != "und" and s >= least for x, s in found], pa.bool_())

    return docs.where(F.arrow_udf(sure, "boolean")(F.col(f"`{text}`").cast("string")))
