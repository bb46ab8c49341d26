"""Language-model scores: subword lattices over an existing piece vocabulary, beside word counts of the corpus.

A text is a sequence of words and the end. ``score`` takes a word's probability
as the sum over all its segmentations into pieces of the existing unigram
vocabulary, weighted by the vocabulary's scores (``lattice``, which says
how a score becomes a probability), and the end's from the number of documents
and tokens learnt from; a text's probability is their product, so the marginal
over all segmentations of the whole text.

With ``rounds`` the scores are a prior only: in each round every distinct
training word is read once, the expected uses of the pieces in it are added up
(forward and backward along its lattice), and these and ``PRIOR`` uses dealt
by the prior make the pieces' new probabilities. Each word counts once, as the
pieces serve words that were not seen.

What the corpus teaches about words goes into further columns: ``base_score``,
the add-one word model, and ``adapted_score``, in which a word seen in training
has one more arc over the whole word that carries its discounted share of the
training words, the discount being the lattice's share. Both models sum to one
over texts, white space aside.

Words are counted over all training documents. At scoring time the words with
the highest counts, ``FREQUENT`` at most, are looked up in each task; the others
are scored by the lattice where they are read and shuffled to their counts as
64-bit hashes, so no table that grows with the corpus is broadcast and no word
travels. Words of equal hash would share a count.

Defined results: a null, empty or blank text is the end token alone; with no
training document counts are 0 and the lattice alone scores; rows with null or
equal ids and repeated rows are scored each for itself, alike, a null id in the
fold of the empty text; very long texts are read whole, and of a very long word
a band as wide as the longest piece is held; an empty table gives an empty
result; other columns, whatever their names and the case of these, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import fold, quoted
from corpusql.llm.lattice import Lattice, vocabulary
from corpusql.llm.tokens import tokenizer_file

FREQUENT = 1 << 18
FREQUENT_BYTES = 64  # longer words are never broadcast
HELD_WORDS = 1 << 18  # distinct words a task counts before it passes them on, or keeps the lattice's scores of
LATTICE_WORDS, LATTICE_BYTES = 1 << 16, 1 << 22  # words, and their bytes, that are brought to the lattice at a time
PRIOR = 1_000  # uses of pieces that the vocabulary's own scores stand for in learning
HASH_SEED = 42  # that of the built-in xxhash64


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered: on bytes, lower() changes only these and split() cuts at ASCII white space."""
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over column ``text``; each task adds up its words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"]
            )
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) >= HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Counts that the formulas need, and the vocabulary's file."""

    documents: int
    words: int
    distinct: int
    discount: float
    path: str
    learnt: np.ndarray | None = None  # probabilities of pieces and bytes, in place of the vocabulary's own

    @property
    def tokens(self) -> int:
        return self.words + self.documents

    @property
    def types(self) -> int:
        return self.distinct + (self.documents > 0)

    @property
    def end(self) -> float:
        """Probability that the next token is the end."""
        return (self.documents + 1) / (self.tokens + 2)

    def lattice(self) -> Lattice:
        known = vocabulary(tokenizer_file(self.path))
        return Lattice(known, known.prior if self.learnt is None else self.learnt)

    def base(self, c: Column) -> Column:
        """log10 of the add-one probability of a token with this count."""
        return F.log10((c + 1) / F.lit(float(self.tokens + self.types + 1)))

    def score(self, marginal: Column) -> Column:
        """log10 probability of a word whose lattice has this natural log probability."""
        return (marginal + float(np.log1p(-self.end))) / float(np.log(10))

    def adapted(self, c: Column, marginal: Column) -> Column:
        """The same with the word's discounted count as one more arc."""
        if not self.words:
            return self.score(marginal)
        left = F.lit(float(np.log(self.discount * self.distinct / self.words))) + marginal
        arc = F.log((c - self.discount) / self.words)
        most = F.greatest(left, F.coalesce(arc, left))
        whole = most + F.log(F.exp(left - most) + F.coalesce(F.exp(arc - most), F.lit(0.0)))
        return self.score(F.when(c > 0, whole).otherwise(left))


def train(texts: DataFrame, vocabulary_path: str) -> tuple[Model, DataFrame]:
    """The model and the table (word, c, h) of word counts and hashes, over all rows of column ``text``."""
    documents = texts.count()
    counts = scratch.table(word_counts(texts).withColumn("h", F.xxhash64("word")), "word_counts")
    sums = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("words"),
        F.count("*").alias("distinct"),
        F.count(F.when(F.col("c") == 1, 1)).alias("once"),
        F.count(F.when(F.col("c") == 2, 1)).alias("twice"),
    ).first()
    discount = min(0.95, max(0.05, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    return Model(documents, sums["words"], sums["distinct"], discount, vocabulary_path), counts


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, more at a time: the lattice computes words of one length together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LATTICE_WORDS or sum(b.nbytes for b in held) >= LATTICE_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def learn(model: Model, counts: DataFrame) -> Model:
    """The model after one more round of learning the pieces from all distinct words of ``counts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        total = np.zeros(len(lattice.log))
        for rows in _larger(batches):
            total += lattice.expected(rows.column(0).to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    prior = vocabulary(tokenizer_file(model.path)).prior
    uses = PRIOR * prior
    sums = counts.select("word").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece
    uses[sums.column("piece").to_numpy()] += sums.column("n").to_numpy()
    return replace(model, learnt=uses / uses.sum())


def _frequent(model: Model, counts: DataFrame) -> dict[bytes, tuple[float, float, float]]:
    """Base, score and adapted score of the most frequent words, ``FREQUENT`` at most."""
    bucket = F.floor(F.log2("c") * 8).cast("int")
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES).withColumn("bucket", bucket)
    sizes = sorted(((r["bucket"], r["n"]) for r in short.groupBy("bucket").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for number, n in sizes:
        total += n
        if total > FREQUENT:
            break
        least = number
    if least is None:
        return {}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        for rows in _larger(batches):
            yield from rows.append_column("m", pa.array(lattice.marginals(rows.column(0).to_pylist()))).to_batches()

    c, m = F.col("c"), F.col("m")
    rated = short.filter(F.col("bucket") >= least).select("word", "c").mapInArrow(rate, "word string, c long, m double")
    rows = rated.select("word", model.base(c).alias("b"), model.score(m).alias("s"), model.adapted(c, m).alias("a")).toArrow()
    words, *values = (rows.column(name).to_pylist() for name in ("word", "b", "s", "a"))
    return dict(zip((w.encode() for w in words), zip(*values, strict=True), strict=True))


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str = "piece_bpe_32k.model",
    folds: int = 7,
    held: int = 2,
    rounds: int = 0,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and adapted_score (log10).

    ``rounds`` of learning come before the scores; without any the pieces keep the vocabulary's own.
    """
    spark = docs.sparkSession
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    model, counts = train(slim.filter(fold(F.col("doc_id"), folds) != held), vocabulary_path)
    for _ in range(rounds):
        model = learn(model, counts)
    table = spark.sparkContext.broadcast(_frequent(model, counts))  # FREQUENT words of FREQUENT_BYTES at most
    end_base, end_score = float(np.log10((model.documents + 1) / (model.tokens + model.types + 1))), float(np.log10(model.end))
    end_known = int(model.documents > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A summary row for each document, and one for each of its other words with the lattice's score of it."""
        from xxhash import xxh64_intdigest

        get, lattice = table.value.get, model.lattice()
        scored: dict[bytes, tuple[int, float]] = {}  # hash and marginal of words that are not frequent
        for batch in batches:
            rows = batch.column(0).to_pylist()
            bags = [Counter(words_of(t.as_py())) for t in batch.column(2)]
            if len(scored) > HELD_WORDS:
                scored.clear()
            new = list({w for bag in bags for w in bag if w not in scored and get(w) is None})
            found = lattice.marginals([w.decode() for w in new])
            scored.update((w, (xxh64_intdigest(w, HASH_SEED), m)) for w, m in zip(new, found.tolist(), strict=True))
            # Rows of the output: place in the batch for summaries, else null; then the columns.
            place, row, h, n, known, base, total, adapted = [], [], [], [], [], [], [], []
            for i, bag in enumerate(bags):
                b, s, a, k = end_base, end_score, end_score, end_known
                for w, times in bag.items():
                    if (own := get(w)) is not None:
                        b += times * own[0]
                        s += times * own[1]
                        a += times * own[2]
                        k += times
                    else:
                        hashed, marginal = scored[w]
                        place.append(None)
                        row.append(rows[i])
                        h.append(hashed)
                        n.append(times)
                        known.append(None)
                        base.append(None)
                        total.append(marginal)
                        adapted.append(None)
                place.append(i)
                row.append(rows[i])
                h.append(None)
                n.append(bag.total() + 1)
                known.append(k)
                base.append(b)
                total.append(s)
                adapted.append(a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int64()),
                    batch.column(1).take(pa.array(place, pa.int64())),
                    pa.array(h, pa.uint64()).view(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(total, pa.float64()),
                    pa.array(adapted, pa.float64()),
                ],
                ["row", "doc_id", "h", "n", "known", "base", "total", "adapted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    marks = scratch.table(
        numbered.mapInArrow(read, f"row long, doc_id {kind}, h long, n long, known long, base double, total double, adapted double"), "marks"
    )
    hashed = counts.groupBy("h").agg(F.sum("c").alias("c"))
    c, m, n = F.coalesce("c", F.lit(0)), F.col("total"), F.col("n")
    others = (
        marks.filter(F.col("h").isNotNull())
        .select("row", "h", "n", "total")
        .join(hashed, "h", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, n).otherwise(0)).alias("k"),
            F.sum(n * model.base(c)).alias("b"),
            F.sum(n * model.score(m)).alias("t"),
            F.sum(n * model.adapted(c, m)).alias("a"),
        )
    )
    zero = F.lit(0)
    return (
        marks.filter(F.col("h").isNull())
        .join(others, "row", "left")
        .select(
            "doc_id",
            (fold(F.col("doc_id"), folds) == held).alias("held_out"),
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("k", zero)).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
            (F.col("total") + F.coalesce("t", zero)).alias("score"),
            (F.col("adapted") + F.coalesce("a", zero)).alias("adapted_score"),
        )
    )
