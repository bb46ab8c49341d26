"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source, targets and repetition rates follow from the
sums, and each document is taken floor(rate) times plus one hash-seeded
Bernoulli copy with probability equal to the rate's fraction.

A document's draw is 48 bits of the md5 of its id. A source's seed turns the
draws of its documents by some ``SEEDS``-th parts of the range, and a turned
draw below the fraction gives the copy: for one seed fixed beforehand each document is drawn with
the fraction as probability. One seed misses a source's target by
the luck of its long documents, so of all ``SEEDS`` that one is taken whose words
come nearest, the least on ties. Given a table the seed is thus chosen by its
result, and a document's probability is no longer the fraction: a source of one
document is rounded to all or nothing, and the words of a source of few documents are
rounded to the nearest of at most ``SEEDS`` sums; with many documents each is
drawn about as often as the fraction says. The words of every seed are summed per source
in one aggregation, which is partial in each task, so that no source meets in
one task and no document is put in order.

Defined results: a null text has 0 words, and so has a blank one; a null source
is a source of its own, last in order; a null id draws as the empty text; rows
with equal ids draw alike, repeated rows too; where all texts are empty every
target is 0 and nothing is taken; an empty table gives an empty result; very
long texts are counted whole; other columns, whatever their names and the case
of these, are passed on by ``mixed_rows`` and ignored by ``mix``. The
sources themselves, one row each, are put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import fresh, n_words, quoted

WEIGHTS = (5, 2, 1)
DRAW_BITS = 48
SEEDS = 32


def _draw(doc_id: Column) -> Column:
    """The draw of an id, from 0 to 2**48 - 1."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _drawn(draw: Column, seed: Column, limit: Column) -> Column:
    """Whether a draw, turned by a seed, is below the limit."""
    step = F.lit((1 << DRAW_BITS) // SEEDS).cast("long")
    return (draw + seed * step).bitwiseAND(F.lit((1 << DRAW_BITS) - 1).cast("long")) < limit


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, copies and limit (the fraction times 2**48) for each source; one row per source is all that meets.

    Sources ordered by name take the weights in turn. Targets share ``share``
    times all words by weight; one that would pass ``cap`` times its source's
    words stops there and the excess goes to the others by weight. Sources
    stop in order of words per weight, so the level at which the rest stands
    follows from running sums.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    stood = weighed.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    # The first source that does not stop sets the level of all that follow; later levels are lower.
    shared = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), cap * F.col("source_size")).otherwise(shared * F.col("weight"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return (
        stood.withColumn("target", target.cast("double"))
        .withColumn("copies", F.floor(rate).cast("long"))
        .withColumn("limit", F.floor((rate - F.floor(rate)) * float(1 << DRAW_BITS)).cast("long"))
        .select("source", "source_size", "target", "copies", "limit")
    )


def _seeded(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Add to the plan the seed whose draws come nearest to the target."""
    named = plan.select(F.col("source").alias("s"), "limit")
    # The plan is a written table of one row per source; its size decides how it is met.
    met = sizes.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("s"))).filter("limit > 0")
    words = [F.sum(F.when(_drawn(F.col("draw"), F.lit(seed).cast("long"), F.col("limit")), F.col("size"))).alias(f"w{seed}") for seed in range(SEEDS)]
    sums = met.groupBy("s").agg(*words)
    missed = plan.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *plan.columns,
        *[F.abs(F.coalesce(f"w{seed}", F.lit(0)) + F.col("copies") * F.col("source_size") - F.col("target")).alias(f"m{seed}") for seed in range(SEEDS)],
    )
    order = F.array(*[F.struct(F.col(f"m{seed}").alias("missed"), F.lit(seed).cast("long").alias("seed")) for seed in range(SEEDS)])
    return missed.select(*plan.columns, F.array_min(order)["seed"].alias("seed"))


def plan(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target, copies, limit and seed of each source, for rows of (source, draw, size)."""
    wanted = scratch.table(targets(sizes, weights, share, cap), "targets")
    return scratch.table(_seeded(sizes, wanted), "plan")


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and draw of every row, written."""
    return scratch.table(
        df.select(
            quoted(id_col).alias("doc_id"),
            quoted(source_col).alias("source"),
            n_words(quoted(text_col)).alias("size"),
            _draw(quoted(id_col)).alias("draw"),
        ),
        "sizes",
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken and n_copies.

    ``taken`` is the words that the mix takes of the document, repeats counted.
    """
    sizes = _sizes(df, id_col, text_col, source_col)
    decided = plan(sizes, weights, share, cap).withColumnRenamed("source", "s")
    return (
        sizes.join(decided, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("n_copies", F.col("copies") + _drawn(F.col("draw"), F.col("seed"), F.col("limit")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")
    )


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with all their columns.

    The plan, a row for each source, meets the documents where they lie, so
    texts are not shuffled unless there are very many sources.
    """
    columns = df.columns
    decided = plan(_sizes(df, id_col, text_col, source_col), weights, share, cap)
    held, met, copy = fresh(columns, "plan", "source", "copy")
    named = decided.select(F.col("source").alias(met), F.struct("copies", "limit", "seed").alias(held))
    part = lambda name: quoted(held)[name]
    n = part("copies") + _drawn(_draw(quoted(id_col)), part("seed"), part("limit")).cast("long")
    taken = df.join(named, quoted(source_col).eqNullSafe(F.col(met))).withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    return taken.drop(held, met, copy)
