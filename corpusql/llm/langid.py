"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one
blank, and n-grams of one to three characters are hashed into ``BUCKETS``
buckets. Document frequencies are counted over all labelled documents that may
be learnt from; the weights come from a bounded sample of them, at most
``TRAIN_ROWS`` of each language and ``TRAIN_BYTES`` of text, by
follow-the-regularised-leader with an elastic-net penalty, which leaves most
weights at zero. One sampled row in five is kept back to fit the temperature
that divides the logits.

Defined results: a null or empty text, one without letters, and every text
where nothing could be learnt, as in an empty table, get ``und`` and score 0;
ties between languages go to the first by name; rows with a null lang or text
are not learnt from; a null id is in the fold of the empty text; rows of equal
id and text are one training row and are predicted each for itself, alike; very
long texts are hashed whole, a slice at a time; other columns, whatever their
names and the case of these, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.columns import fold, quoted
from corpusql.llm.samples import labelled_sample, row_hash

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
TRAIN_ROWS = 1_000
TRAIN_BYTES = 32 << 20
CALIBRATE_ONE_IN = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SLICE = 1 << 20  # characters hashed at once

_GAPS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """The letters of a text with single blanks between runs; empty if there is none."""
    joined = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {joined} " if any(map(str.isalpha, joined)) else ""


def gram_counts(letters: str) -> np.ndarray:
    """How often the n-grams of a text fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKET_BITS)
    for at in range(0, len(letters), SLICE):
        c = np.frombuffer(letters[max(0, at - 2) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = 0 if at == 0 else 2  # characters that the slice before has counted
        one = (c + np.uint32(1)) * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] + np.uint32(77))) * np.uint32(2246822519)
        three = (two[:-1] ^ (c[2:] + np.uint32(991))) * np.uint32(3266489917)
        for grams, size in ((one, 1), (two, 2), (three, 3)):
            counts += np.bincount(grams[max(0, new - size + 1) :] >> shift, minlength=BUCKETS)
    return counts


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float

    def features(self, letters: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their TF-IDF values, of unit length."""
        counts = gram_counts(letters)
        where = np.flatnonzero(counts)
        values = (1 + np.log(counts[where])) * self.idf[where]
        return where, values / np.sqrt((values * values).sum())

    def logits(self, letters: str) -> np.ndarray:
        where, values = self.features(letters)
        return values @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text)
        if not letters or not self.names:
            return UNKNOWN, 0.0
        odds = _softmax(self.logits(letters) / self.temperature)
        best = int(odds.argmax())
        return self.names[best], float(odds[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth] + 1e-12).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(texts: list[str], tongues: list[str], idf: np.ndarray, seed: int = 11) -> Model:
    """FTRL-proximal over ``EPOCHS`` shuffled passes, then the temperature."""
    rows = [(x, t) for x, t in ((letters_of(x), t) for x, t in zip(texts, tongues, strict=True)) if x]
    names = sorted({t for _, t in rows})
    k = len(names)
    model = Model(names, idf, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)
    if k < 2:
        return model
    truth = np.array([names.index(t) for _, t in rows])
    data = [model.features(x) for x, _ in rows]
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    kept = np.flatnonzero(np.arange(len(rows)) % CALIBRATE_ONE_IN != 0)
    rng = np.random.default_rng(seed)
    bias_n = np.zeros(k)

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(kept):
            where, values = data[i]
            w = solved(z[where], n[where])
            error = _softmax(values @ w + model.bias)
            error[truth[i]] -= 1
            g = values[:, None] * error
            grown = n[where] + g * g
            z[where] += g - (np.sqrt(grown) - np.sqrt(n[where])) / ALPHA * w
            n[where] = grown
            bias_n += error * error
            model.bias -= ALPHA * error / (BETA + np.sqrt(bias_n))
    model.weights = solved(z, n)
    calibrate = np.setdiff1d(np.arange(len(rows)), kept)
    logits = np.array([data[i][1] @ model.weights[data[i][0]] + model.bias for i in calibrate])
    model.temperature = _temperature(logits, truth[calibrate])
    return model


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of every bucket over all rows of column ``text``; each task sends one sum per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if letters := letters_of(t.as_py()):
                    rows += 1
                    seen += gram_counts(letters) > 0
        where = np.flatnonzero(seen)
        bucket = np.concatenate([[-1], where])
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(np.concatenate([[rows], seen[where]]), pa.int64())], ["bucket", "n"]
        )

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in sums.collect()}  # BUCKETS + 1 rows at most
    total = found.pop(-1, 0)
    frequency = np.zeros(BUCKETS)
    if found:
        frequency[list(found)] = list(found.values())
    return np.log((1 + total) / (1 + frequency)) + 1


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int) -> Model:
    rows = (
        docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .filter(fold(F.col("id"), folds) != held)
    )
    keys = rows.select("lang", row_hash().alias("h"), F.octet_length("text").cast("long").alias("size"))
    sample = labelled_sample(rows.select("id", "text"), keys, "lang", TRAIN_ROWS, TRAIN_BYTES)
    return train([r["text"] for r, _ in sample], [lang for _, lang in sample], inverse_frequencies(rows))


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score, the probability of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, folds, held))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
        .mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
        .select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
    )
