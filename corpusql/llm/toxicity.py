"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
first characters, so that unseen forms of a known stem are near it. Filters of
several widths run over the whole text, each keeps its strongest response
(max pooling), and a logistic layer turns these into a score. Word counts of
the training rows give a guess of the text's language; for each language the
threshold that best separates the calibration rows is moved to 0.5, in
proportion to the guess. At scoring time only the text is read. Languages with
fewer than ``LEAST_OF_LANGUAGE`` training rows are not guessed; of more than
``LANGUAGES`` the rarest are taken as one. A language whose calibration rows
have fewer than ``LANGUAGE_ROWS`` of either label takes the threshold of all
calibration rows.

All labelled rows outside the held fold are used, with whole texts. Word counts
are summed over them. Four in five train: in a round, each task carries the model
on over its own rows, one after another, and the changes of all tasks are added up
and averaged, an embedding's over the tasks that moved it. The other fifth is
scored by the trained model; thresholds come from the counts of its logits, which
are taken in steps of one in ``GRAIN``. Sums are of whole numbers, so they do not
depend on the order of tasks. What comes to the driver has the size of the model
or of a table of logits, however many rows there are. All rows are gone over
``PASSES`` times, few rows more often, so that some ``STEPS`` batches are seen. Training and scoring read every
whole text, and pool it in overlapping windows.

Defined results: a null text counts as empty and scores as one padding word;
null labels, null ids and labels without a row are not used; several labels of
one id count as their maximum; rows of equal id and text are one training row
and are scored each for itself, alike; texts are scored whole, however long;
without rows of both labels every score is the share of toxic ones (0 without
any rows); an empty table gives an empty result; other columns, whatever their
names and the case of these, are passed on by ``drop_toxic`` and ignored by
``toxicity``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from corpusql.llm.columns import fold, fresh, quoted, with_columns
from corpusql.llm.samples import row_hash
from corpusql.llm.scratch import table as written

CALIBRATE_ONE_IN = 5
SHARD_ROWS = 4_096  # labelled rows in a file of the training table
HELD_WORDS = 1 << 23  # a task holds the rows of so many words at a time, as numbers
PASSES = 2  # over all training rows at least
ROUNDS = 4  # at most; after each the tasks' models are averaged
GRAIN = 256
LOGITS = 64  # thresholds lie between - and + so much
FIXED = 1 << 32  # changes are summed in steps of one in so many
BUCKETS = 1 << 18
STEMS = (3, 4, 5, 6)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
STEPS = 2_500
BATCH = 16
RATE = 0.004
DROP = 0.3
LEAST_ROWS = 4  # training rows that a bucket must occur in to get an embedding
CLEAN_WEIGHT = 5.0  # some rows are labelled toxic without a word that tells: they must not pull clean ones along
LANGUAGE_ROWS = 20  # of each label, for a threshold of its own
LANGUAGES = 32  # kept apart
LEAST_OF_LANGUAGE = 10  # training rows
WINDOW = 1 << 13
KNOWN_WORDS = 1 << 19

_WORDS = re.compile(r"\w+")
_TAPS = [(w, k) for w in WIDTHS for k in range(w)]
_OF_TAP = np.array([np.arange(FILTERS) + WIDTHS.index(w) * FILTERS for w, _ in _TAPS])  # the filters that each tap is of
_AFTER = np.array([[k] for _, k in _TAPS])


def _hashes(word: str) -> tuple[int, ...]:
    """Of the word, then of its first characters."""
    whole = word.encode()
    text = whole if len(whole) == len(word) else None
    return zlib.crc32(whole), *[zlib.crc32(text[:k] if text is not None else word[:k].encode(), k) for k in STEMS]


def buckets_of(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its first characters, a row each; bucket 0 is padding."""
    hashes = np.array([_hashes(w) for w in words], np.int64).reshape(-1, 1 + len(STEMS))
    return (hashes % (BUCKETS - 1) + 1).astype(np.int32)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower()) or [""]


@dataclass
class Model:
    """Embeddings, filters by tap, output layer, language table and thresholds."""

    slots: np.ndarray  # (BUCKETS): row of each bucket in the two tables below; row 0 is zero and serves all rare buckets
    embedding: np.ndarray
    taps: np.ndarray  # (taps, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray
    offset: float
    languages: np.ndarray  # (rows, languages): log odds of a word
    thresholds: np.ndarray

    def vectors(self, words: list[str]) -> np.ndarray:
        parts = self.slots[buckets_of(words)]
        return np.concatenate([_summed(self.embedding, parts), self.languages[parts[:, 0]]], axis=1)

    def products(self, vectors: np.ndarray) -> np.ndarray:
        """What each tap of each filter makes of (words, DIM) vectors: (taps, words, FILTERS)."""
        return np.matmul(vectors, self.taps)

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.out + self.offset)


def _runs(take: Callable[[int, int, int], np.ndarray], words: int) -> Iterator[np.ndarray]:
    """For each width, the filters' responses at each place of so many words; ``take`` gives a tap's products of words from one place to another."""
    for width in WIDTHS:
        first, n = _TAPS.index((width, 0)), max(1, words - width + 1)
        run = take(first, 0, n)
        for k in range(1, min(width, words)):  # in a text shorter than the filter the missing words are zero
            run = run + take(first + k, k, n + k)
        yield run


def pooled(products: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's strongest response in a text, and where it begins."""
    best, where = None, None
    for start in range(0, len(words), WINDOW - max(WIDTHS) + 1):
        part = words[start : start + WINDOW]
        runs = list(_runs(lambda tap, a, b: products[tap].take(part[a:b], axis=0), len(part)))  # noqa: B023
        at = np.concatenate([run.argmax(axis=0) for run in runs])
        own = np.concatenate([run[i, np.arange(FILTERS)] for run, i in zip(runs, at.reshape(len(WIDTHS), FILTERS), strict=True)])
        if best is None:
            best, where = own, at
        else:
            where = np.where(own > best, at + start, where)
            best = np.maximum(best, own)
        if start + WINDOW >= len(words):
            break
    return best, where


def _summed(table: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of the table's rows that each row of ``parts`` names."""
    total = table.take(parts[:, 0], axis=0)
    for i in range(1, parts.shape[1]):
        total += table.take(parts[:, i], axis=0)
    return total


class Words:
    """Numbers of words, given as they come."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.known)

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        return np.array([known.setdefault(w, len(known)) for w in words], np.int32)

    def since(self, first: int) -> list[str]:
        """The words from a number on."""
        return list(islice(reversed(self.known), len(self.known) - first))[::-1]


class Scorer:
    """Scores whole texts; remembers the vectors of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known = Words()
        self.vectors = np.zeros((1 << 12, DIM + model.languages.shape[1]), np.float32)

    def _learn(self, words: list[str], first: int) -> None:
        while first + len(words) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[first : first + len(words)] = self.model.vectors(words)

    def raw(self, text: str | None) -> tuple[float, np.ndarray]:
        """Logit before calibration and the language guess."""
        if len(self.known) > KNOWN_WORDS:
            self.known = Words()
        words = words_of(text)
        best, tongue = None, 0
        step = WINDOW - max(WIDTHS) + 1
        known = self.known
        for at in range(0, len(words), step):
            part = words[at : at + WINDOW]
            first = len(known)
            numbers = known.numbers(part)
            if len(known) > first:
                self._learn(known.since(first), first)
            rows = self.vectors.take(numbers, axis=0)
            products = self.model.products(rows[:, :DIM])
            own = np.concatenate([run.max(axis=0) for run in _runs(lambda tap, a, b: products[tap, a:b], len(part))])
            best = own if best is None else np.maximum(best, own)
            tongue = tongue + rows[:, DIM:].sum(axis=0, dtype=np.float64)
            if at + WINDOW >= len(words):
                break
        if not self.model.languages.shape[1]:
            return self.model.logit(best), np.zeros(0)
        odds = np.exp(tongue - tongue.max())
        return self.model.logit(best), odds / odds.sum()

    def score(self, text: str | None) -> float:
        logit, tongue = self.raw(text)
        shifted = logit - (float(tongue @ self.model.thresholds) if len(tongue) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(shifted, -500, 500))))


@dataclass
class Counts:
    """Of all training rows: how many there are, by label, and in how many each bucket occurs, in all and by language."""

    rows: dict[bool, int]
    seen: np.ndarray  # (BUCKETS)
    tongues: np.ndarray  # (BUCKETS, languages): of whole words only


class Rows:
    """Buckets of texts: all those of their words, and those of whole words, each once."""

    def __init__(self) -> None:
        self.words = Words()
        self.table = np.zeros((1 << 12, 1 + len(STEMS)), np.int32)

    def buckets(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KNOWN_WORDS:
            self.words = Words()
        first = len(self.words)
        own = self.words.numbers(list(set(words_of(text))))
        new = self.words.since(first)
        while len(self.words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(new)] = buckets_of(new)
        parts = self.table[own]
        return np.unique(parts), np.unique(parts[:, 0])


def start(counts: Counts, seed: int = 7) -> Model:
    """The model before training: random weights for frequent buckets, and the language table."""
    rng = np.random.default_rng(seed)
    n, total = len(WIDTHS) * FILTERS, sum(counts.rows.values())
    # What few rows share tells them apart by chance: such buckets stay zero, in training and in scoring.
    rare = counts.seen < min(LEAST_ROWS, max(1, total // 20))
    rare[0] = True
    kept = np.flatnonzero(~rare)
    slots = np.zeros(BUCKETS, np.int32)
    slots[kept] = np.arange(1, len(kept) + 1)
    logs = np.log((counts.tongues + 1.0) / (counts.tongues + 1.0).sum(axis=0))
    logs = (logs - logs.mean(axis=1, keepdims=True) if logs.shape[1] else logs).astype(np.float32)
    model = Model(
        slots,
        np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.1, (len(kept), DIM))]).astype(np.float32),
        rng.normal(0, 0.3, (len(_TAPS), DIM, FILTERS)).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, n).astype(np.float32),
        0.0,
        np.concatenate([np.zeros_like(logs[:1]), logs[kept]]),
        np.zeros(logs.shape[1]),
    )
    if not all(counts.rows.get(kind) for kind in (False, True)):
        share = np.clip(counts.rows.get(True, 0) / max(1, total), 1e-300, 1)
        model.out[:] = 0
        model.offset = float(np.log(share) - np.log1p(-share)) if share < 1 else 500.0
    return model


def learn(model: Model, rows: Iterator[tuple[str | None, bool]], counts: dict[bool, int], passes: int, rate: float) -> int:
    """Carry the model on over rows (text, label), ``passes`` times over those held at a time; returns how many there were."""
    known, held = Words(), []
    words, n = 0, 0

    def spend() -> None:
        _adam(model, held, model.slots[buckets_of(known.since(0))], counts, passes, rate)

    for text, label in rows:
        own = known.numbers(words_of(text))
        held.append((own, label))
        words, n = words + len(own), n + 1
        if words >= HELD_WORDS or len(known) > KNOWN_WORDS:
            spend()
            known, held, words = Words(), [], 0
    if held:
        spend()
    return n


def _added(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of values summed by place, of which each occurs."""
    order = np.argsort(at, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(at[order], np.arange(size)), axis=0)


def _adam(model: Model, rows: list[tuple[np.ndarray, bool]], table: np.ndarray, counts: dict[bool, int], passes: int, rate: float) -> None:
    """Adam steps over batches of rows (word numbers, label); both labels weigh alike over all training rows, the rarer one by coming more often."""
    rng = np.random.default_rng(len(rows))
    times = _times(counts)
    total = sum(counts[kind] * times[kind] for kind in counts)
    weigh = {kind: total / (2 * counts[kind] * times[kind]) for kind in counts}
    again = np.repeat(np.arange(len(rows)), [times[label] for _, label in rows])
    weights = [model.embedding, model.taps, model.bias, model.out]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    drift, step = [0.0, 0.0], 0
    for _ in range(passes):
        order = rng.permutation(again)
        for batch in np.array_split(order, -(-len(order) // BATCH)):
            step += 1
            ends = np.cumsum([len(rows[r][0]) for r in batch])[:-1]
            words, places = np.unique(np.concatenate([rows[r][0] for r in batch]), return_inverse=True)
            own = table[words]
            if DROP:  # hide parts of words, so that stems and whole words each learn what they can
                own = np.where(rng.random(own.shape, np.float32) < DROP, 0, own)
            vectors = _summed(model.embedding, own)
            products = model.products(vectors)
            gradient = [np.zeros_like(w) for w in weights[1:]]
            gradient = [np.zeros_like(w) for w in weights[1:]]
            offset = 0.0
            told_by = np.zeros((len(_TAPS), len(batch), FILTERS), np.int64)  # rows of vectors
            push = np.zeros((len(_TAPS), len(batch), FILTERS), np.float32)
            for i, (r, mine) in enumerate(zip(batch, np.split(places, ends), strict=True)):
                label = rows[r][1]
                best, at = pooled(products, mine)
                active = np.maximum(best + model.bias, 0)
                error = weigh[label] * (1 / (1 + np.exp(-np.clip(float(active @ model.out + model.offset), -500, 500))) - label) / len(batch)
                gradient[2] += error * active
                offset += error
                back = error * model.out * (active > 0)
                gradient[1] += back
                place = at[_OF_TAP] + _AFTER
                push[:, i] = back[_OF_TAP] * (place < len(mine))
                told_by[:, i] = mine[np.minimum(place, len(mine) - 1)]
            gradient[0] += np.einsum("tbfd,tbf->tdf", vectors[told_by], push)
            pulls = np.einsum("tbf,tdf->tbfd", push, model.taps).reshape(-1, DIM)
            moved, inverse = np.unique(told_by, return_inverse=True)
            pull = _added(pulls, inverse.ravel(), len(moved))
            unique, inverse = np.unique(own[moved], return_inverse=True)
            spread = _added(np.repeat(pull, own.shape[1], axis=0), inverse.ravel(), len(unique))
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            # Embeddings take their Adam step only where the batch touched them.
            for w, m, v, g, touched in [(weights[0], first[0], second[0], spread, unique)] + [
                (w, m, v, g, slice(None)) for w, m, v, g in zip(weights[1:], first[1:], second[1:], gradient, strict=True)
            ]:
                m[touched] = 0.9 * m[touched] + 0.1 * g
                v[touched] = 0.999 * v[touched] + 0.001 * g * g
                w[touched] -= scale * m[touched] / (np.sqrt(v[touched]) + 1e-8) + rate * 1e-3 * w[touched]
            model.embedding[0] = 0
            drift = [0.9 * drift[0] + 0.1 * offset, 0.999 * drift[1] + 0.001 * offset**2]
            model.offset -= scale * drift[0] / (drift[1] ** 0.5 + 1e-8)


def _times(counts: dict[bool, int]) -> dict[bool, int]:
    """How often a pass takes each row of a label, so that both labels come about alike often."""
    most = max(counts.values())
    return {kind: max(1, most // max(1, n)) for kind, n in counts.items()}


def _plan(counts: dict[bool, int], steps: int) -> tuple[int, int]:
    """Rounds, and how often each goes over the rows."""
    times = _times(counts)
    batches = -(-sum(n * times[kind] for kind, n in counts.items()) // BATCH)
    passes = max(PASSES, steps // batches)
    rounds = min(ROUNDS, passes)
    return rounds, -(-passes // rounds)


def _copy(model: Model) -> Model:
    return replace(model, embedding=model.embedding.copy(), taps=model.taps.copy(), bias=model.bias.copy(), out=model.out.copy())


def _dense(model: Model) -> np.ndarray:
    """All weights but the embeddings, in rows as wide as these."""
    flat = np.concatenate([model.taps.ravel(), model.bias, model.out, [model.offset]]).astype(np.float64)
    return np.concatenate([flat, np.zeros(-len(flat) % DIM)]).reshape(-1, DIM)


def moves(before: Model, after: Model, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (embeddings from 0, the other weights below), weights and changes times these, as whole numbers."""
    moved = np.flatnonzero((after.embedding != before.embedding).any(axis=1))
    dense = _dense(after) - _dense(before)
    places = np.concatenate([moved, -1 - np.arange(len(dense))])
    change = np.concatenate([(after.embedding[moved] - before.embedding[moved]).astype(np.float64), dense])
    return places.astype(np.int32), np.full(len(places), weight, np.int64), np.rint(change * FIXED * weight).astype(np.int64)


def advance(model: Model, places: np.ndarray, weights: np.ndarray, changes: np.ndarray) -> Model:
    """The model after the summed moves of all tasks."""
    new, mean = _copy(model), changes / FIXED / np.maximum(1, weights)[:, None]
    rows = places >= 0
    new.embedding[places[rows]] += mean[rows].astype(np.float32)
    dense = _dense(model)
    dense[-1 - places[~rows]] += mean[~rows]
    flat, n = dense.ravel(), len(new.bias)
    taps, bias, out, offset = np.split(flat[: model.taps.size + 2 * n + 1], np.cumsum([model.taps.size, n, n]))
    return replace(new, taps=taps.reshape(model.taps.shape).astype(np.float32), bias=bias.astype(np.float32), out=out.astype(np.float32), offset=float(offset[0]))


def _threshold(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Middle of the widest gap among those with the best share caught less ``CLEAN_WEIGHT`` times the share of clean rows lost; of counts by ascending logit."""
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    lost = 1 - np.concatenate([[0], np.cumsum(clean)]) / max(1, clean.sum())
    cost = missed + CLEAN_WEIGHT * lost
    edges = np.concatenate([[logits[0] - 1], logits, [logits[-1] + 1]])
    gaps = np.where(cost <= cost.min() + 1e-12, edges[1:] - edges[:-1], -1)
    i = int(gaps.argmax())
    return float((edges[i] + edges[i + 1]) / 2)


def told(scorer: Scorer, text: str | None) -> tuple[int, int]:
    """The language guessed (-1: none) and the logit in steps."""
    logit, tongue = scorer.raw(text)
    return (int(tongue.argmax()) if len(tongue) else -1), int(np.rint(np.clip(logit, -LOGITS, LOGITS) * GRAIN))


def calibrated(model: Model, found: list[tuple[int, int, int, int]]) -> Model:
    """The model with thresholds from rows (language, logit in steps, toxic rows, clean rows)."""

    def best(rows: np.ndarray) -> float:
        steps, at = np.unique(rows[:, 1], return_inverse=True)
        toxic, clean = (np.bincount(at, rows[:, i]) for i in (2, 3))
        return _threshold(steps / GRAIN, toxic, clean)

    table = np.array(found, np.int64).reshape(-1, 4)
    whole = best(table) if table[:, 2:].sum(axis=0).all() else 0.0
    if not len(model.thresholds):
        return replace(model, offset=model.offset - whole)
    own = [table[table[:, 0] == i] for i in range(len(model.thresholds))]
    return replace(model, thresholds=np.array([best(rows) if rows[:, 2:].sum(axis=0).min() >= LANGUAGE_ROWS else whole for rows in own]))


def train(texts: list[str | None], toxic: list[int], tongues: list[str | None], steps: int = STEPS) -> Model:
    """Fit to rows at hand, as ``fit`` does to rows of a table in one task."""
    labels = [bool(t) for t in toxic]
    names = [t for t, n in sorted(Counter(t for t in tongues if t is not None).items(), key=lambda x: (-x[1], x[0])) if n >= LEAST_OF_LANGUAGE]
    counts = Counts(Counter(labels), np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, min(len(names), LANGUAGES)), np.int64))
    rows = Rows()
    for text, tongue in zip(texts, tongues, strict=True):
        seen, whole = rows.buckets(text)
        counts.seen[seen] += 1
        if tongue in names:
            counts.tongues[whole, min(names.index(tongue), LANGUAGES - 1)] += 1
    model = start(counts)
    if len(counts.rows) < 2:
        return model
    kept = [i for i in range(len(labels)) if i % CALIBRATE_ONE_IN]
    if len({labels[i] for i in kept}) < 2:
        kept = list(range(len(labels)))
    own = Counter(labels[i] for i in kept)
    learn(model, ((texts[i], labels[i]) for i in kept), own, math.prod(_plan(own, steps)), RATE)
    scorer = Scorer(model)
    return calibrated(model, [(*told(scorer, texts[i]), int(labels[i]), int(not labels[i])) for i in range(0, len(labels), CALIBRATE_ONE_IN)])


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int) -> DataFrame:
    """All labelled rows outside fold ``held``, those of equal id and text once: text, lang, toxic, calibrate; written."""
    known = written(
        labels.filter(F.col("toxic").isNotNull() & quoted(id_col).isNotNull())
        .groupBy(quoted(id_col).alias("id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .filter(fold(F.col("id"), folds) != held),
        "known",
    )
    # Files of some thousand rows: as many tasks can train at a time. Dealt alike, the two sides meet where they are.
    files = 1 + known.count() // SHARD_ROWS
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).filter(
        F.col("id").isNotNull() & (fold(F.col("id"), folds) != held)
    )
    met = rows.repartition(files, "id").join(known.repartition(files, "id").hint("merge"), "id")
    once = met.groupBy("id", row_hash().alias("h"), "toxic").agg(F.first("text").alias("text"), F.max("lang").alias("lang"))
    calibrate = F.pmod(F.shiftright("h", 16), F.lit(CALIBRATE_ONE_IN)) == 0
    return written(once.select("text", "lang", "toxic", calibrate.alias("calibrate")), "training")


def _counts(rows: DataFrame, by_kind: dict[bool, int]) -> Counts:
    """Buckets' counts over all rows; languages by falling count of rows, those beyond ``LANGUAGES`` as the last of these."""
    named = rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_OF_LANGUAGE)
    place = F.least(F.row_number().over(Window.orderBy(F.desc("n"), "lang")) - 1, F.lit(LANGUAGES - 1))
    tongues = written(named.select("lang", place.alias("tongue")), "tongues")  # one row for each language
    width = (tongues.agg(F.max("tongue")).first()[0] + 1) if not tongues.isEmpty() else 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = np.zeros((BUCKETS, 1 + width), np.int64), Rows()
        for batch in batches:
            for text, tongue in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen, whole = own.buckets(text.as_py())
                table[seen, 0] += 1
                if tongue is not None:
                    table[whole, 1 + tongue] += 1
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, i]) for i in range(1 + width))], names)

    names = ["bucket", *(f"n{i}" for i in range(1 + width))]
    local = rows.join(tongues, "lang", "left").select("text", "tongue").mapInArrow(count, "bucket int, " + ", ".join(f"{n} long" for n in names[1:]))
    found = local.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()  # at most ``BUCKETS`` rows
    counts = Counts(by_kind, np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, width), np.int64))
    at = found.column("bucket").to_numpy()
    for i, n in enumerate(names[1:]):
        (counts.seen if i == 0 else counts.tongues[:, i - 1])[at] = found.column(n).to_numpy()
    return counts


def _round(rows: DataFrame, model: Model, counts: dict[bool, int], passes: int, rate: float) -> Model:
    """One round: every task carries the model on over its rows; their changes are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(DIM)]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        after = _copy(before)
        own = ((text.as_py(), label) for batch in batches for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True))
        n = learn(after, own, counts, passes, rate)
        if n:
            places, weights, changes = moves(before, after, n)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights), *(pa.array(np.ascontiguousarray(c)) for c in changes.T)], ["place", "weight", *names])

    local = rows.select("text", "toxic").mapInArrow(carry, "place int, weight long, " + ", ".join(f"{n} long" for n in names))
    found = local.groupBy("place").agg(*(F.sum(n).alias(n) for n in ["weight", *names])).toArrow()  # of the size of the model
    shared.unpersist()
    columns = [found.column(n).to_numpy() for n in found.column_names]
    return advance(model, columns[0], columns[1], np.stack(columns[2:], axis=1))


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """Thresholds from all calibration rows, by their counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [told(scorer, text.as_py()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32()), batch.column(1)], ["tongue", "logit", "toxic"])

    told_rows = rows.select("text", "toxic").mapInArrow(tell, "tongue int, logit int, toxic boolean")
    found = told_rows.groupBy("tongue", "logit").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    return calibrated(model, [tuple(r) for r in found.collect()])  # at most two sides of ``LOGITS * GRAIN`` for each language


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int) -> Model:
    """Train on all labelled rows outside fold ``held``."""
    rows = _training_rows(docs, labels, id_col, text_col, lang_col, folds, held)
    sizes = {(r["calibrate"], r["toxic"]): r["n"] for r in rows.groupBy("calibrate", "toxic").agg(F.count("*").alias("n")).collect()}
    by_kind = {kind: sum(n for (_, k), n in sizes.items() if k == kind) for kind in (False, True)}
    model = start(_counts(rows, by_kind))
    if not all(by_kind.values()):
        return model
    training, counts = rows.filter(~F.col("calibrate")), {kind: sizes.get((False, kind), 0) for kind in (False, True)}
    if not all(counts.values()):
        training, counts = rows, by_kind
    rounds, passes = _plan(counts, STEPS)
    for i in range(rounds):
        model = _round(training, model, counts, passes, RATE * (1 - i / (2 * rounds)))
    return _calibrated(rows.filter("calibrate"), model)


def _score(docs: DataFrame, model: Model, text_col: str, into: str) -> DataFrame:
    """Add the score of every whole text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())]

    return with_columns(docs, text_col, [StructField(into, DoubleType())], make)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    held: int = 0,
) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    model = fit(docs, labels, id_col, text_col, lang_col, folds, held)
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return _score(slim, model, "text", "score").select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    held: int = 0,
) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    (score,) = fresh(docs.columns, "score")
    model = fit(docs, labels, id_col, text_col, lang_col, folds, held)
    return _score(docs, model, text_col, score).filter(quoted(score) < 0.5).drop(score)
