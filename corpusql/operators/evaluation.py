"""Measures of retrieval and of generated text."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.vectors import DIGITS


def retrieval_measures(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, precision_at_k, recall_at_k, reciprocal_rank) of every query in ``totals``.

    ``hits`` has query_id, rank from 1 and whether the hit is ``relevant``;
    ``totals`` has query_id and how many items are relevant in all, so the
    pairs of queries and relevant items need not be written out.
    """
    good = hits.filter((F.col("rank") <= k) & F.col("relevant"))
    found = good.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return totals.join(found, "query_id", "left").select(
        "query_id",
        F.round(n / k, DIGITS).alias("precision_at_k"),
        F.round(F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0)), DIGITS).alias("recall_at_k"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("reciprocal_rank"),
    )


def mean_measures(measures: DataFrame) -> DataFrame:
    """One row: mean precision, mean recall and mean reciprocal rank."""
    return measures.agg(
        F.round(F.avg("precision_at_k"), DIGITS).alias("precision_at_k"),
        F.round(F.avg("recall_at_k"), DIGITS).alias("recall_at_k"),
        F.round(F.avg("reciprocal_rank"), DIGITS).alias("mrr"),
    )


def _gram_counts(tokens: list[str], n: int) -> Counter[tuple[str, ...]]:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def _words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def rouge(candidate: Column, reference: Column, n: int = 1) -> Column:
    """Struct of precision, recall and f1 of shared n-grams of lower-cased words, each counted as often as in the rarer text."""

    @F.pandas_udf("precision double, recall double, f1 double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            one, two = _gram_counts(_words_of(x), n), _gram_counts(_words_of(y), n)
            shared, m, k = (one & two).total(), one.total(), two.total()
            rows.append([shared / d if d else 0.0 for d in (m, k)] + [2 * shared / (m + k) if m + k else 0.0])
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    found = run(candidate, reference)
    return F.struct(*[F.round(found[c], DIGITS).alias(c) for c in ("precision", "recall", "f1")])


def bleu(candidate: Column, reference: Column, n: int = 4) -> Column:
    """BLEU with clipped counts up to n words, one added to matches and totals beyond single words, and brevity penalty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        scores = []
        for x, y in zip(a, b, strict=True):
            one, two = _words_of(x), _words_of(y)
            logs = []
            for size in range(1, n + 1):
                grams, more = _gram_counts(one, size), int(size > 1)
                matched = (grams & _gram_counts(two, size)).total() + more
                logs.append(math.log(matched / (grams.total() + more)) if matched else -math.inf)
            brevity = 1.0 if len(one) >= len(two) else math.exp(1 - len(two) / len(one)) if one else 0.0
            scores.append(math.exp(sum(logs) / n) * brevity)
        return pd.Series(scores, dtype="float64")

    return F.round(run(candidate, reference), DIGITS)
