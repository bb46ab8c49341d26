"""Comparison of retrieval systems by a table of metrics, one row per system and query.

Metric rows are (rag_name, query_id, retrieval_time, generation_time,
total_time, confidence_score, chunks_retrieved, response_length, error); rows
with an error take no part in any measure.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.errors import CorpusError, EvaluationError
from corpusql.functions.text import preview
from corpusql.functions.vectors import DIGITS
from corpusql.storage import written

METRICS = ["retrieval_time", "generation_time", "total_time", "confidence_score", "chunks_retrieved", "response_length"]
RANKED = {"total_time": False, "confidence_score": True, "chunks_retrieved": True, "response_length": True}
COLUMNS = (
    "rag_name string, query_id string, retrieval_time double, generation_time double, total_time double, "
    "confidence_score double, chunks_retrieved int, response_length int, error string"
)


class Comparator:
    """Runs registered systems over a table of queries and keeps their metrics.

    A system is a function from queries (query_id, query) to answers
    (query_id, response, confidence, chunks_retrieved), one per query. Answers
    may also state retrieval_time and generation_time, as ``System.query`` does.
    """

    def __init__(self) -> None:
        self.systems: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.history: DataFrame | None = None

    def register(self, name: str, system: Callable[[DataFrame], DataFrame]) -> None:
        self.systems[name] = system

    def compare(self, queries: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Metrics of each system on all queries, added to the history.

        Systems run on whole tables, so the time of a query is its share of
        its system's run. Of answers that do not state how long the search
        took, all of it counts as search. A system that fails has rows of zeros
        with an error; mistakes in its Python code are raised.
        """
        chosen = list(self.systems) if names is None else names
        if unknown := [n for n in chosen if n not in self.systems]:
            raise EvaluationError(f"unknown systems: {unknown}")
        n = max(1, queries.count())
        found = None
        for name in chosen:
            began = time.perf_counter()
            try:
                answers = written(self.systems[name](queries))
                spent = (time.perf_counter() - began) / n
                told = {"retrieval_time", "generation_time"} <= set(answers.columns)
                search, answer = (F.col(c).cast("double") for c in ("retrieval_time", "generation_time")) if told else (F.lit(spent), F.lit(0.0))
                rows = answers.select(
                    F.lit(name).alias("rag_name"), F.col("query_id").cast("string").alias("query_id"),
                    search.alias("retrieval_time"), answer.alias("generation_time"), F.lit(spent).alias("total_time"),
                    F.col("confidence").cast("double").alias("confidence_score"), F.col("chunks_retrieved").cast("int").alias("chunks_retrieved"),
                    F.length("response").cast("int").alias("response_length"), F.lit(None).cast("string").alias("error"),
                )
            except (CorpusError, PySparkException, Py4JError) as e:
                rows = queries.select(
                    F.lit(name).alias("rag_name"), F.col("query_id").cast("string").alias("query_id"),
                    *[F.lit(0.0).alias(c) for c in METRICS[:4]], F.lit(0).alias("chunks_retrieved"), F.lit(0).alias("response_length"), F.lit(str(e)[:500]).alias("error"),
                )
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise EvaluationError("no system is registered")
        self.history = found if self.history is None else self.history.unionByName(found)
        return found

    def clear(self) -> None:
        self.history = None


def _sound(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("error").isNull() | (F.col("error") == ""))


def winners(metrics: DataFrame) -> DataFrame:
    """(query_id, winner, score): 60 % confidence, 30 % speed, 10 % length, each against the query's best; ties by name."""
    query = Window.partitionBy("query_id")
    best = _sound(metrics).select(
        "query_id", "rag_name", "confidence_score", "total_time", "response_length",
        F.max("confidence_score").over(query).alias("top"), F.min("total_time").over(query).alias("least"), F.max("response_length").over(query).alias("longest"),
    )
    part = lambda condition, value: F.when(condition, value).otherwise(0.0)
    score = (
        part(F.col("top") > 0, 0.6 * F.col("confidence_score") / F.col("top"))
        + part(F.col("least") > 0, 0.3 * F.col("least") / F.col("total_time"))
        + part(F.col("longest") > 0, 0.1 * F.least(F.lit(1.0), F.col("response_length") / F.greatest(F.lit(1000.0), 0.7 * F.col("longest"))))
    )
    scored = best.withColumn("score", F.round(score, DIGITS))
    return scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "rag_name")).alias("w")).select(
        "query_id", F.col("w.rag_name").alias("winner"), (-F.col("w.s")).alias("score")
    )


def analysis(metrics: DataFrame) -> DataFrame:
    """Per query: fastest and slowest, most and least confident, and most efficient systems; ties by name."""
    efficiency = F.coalesce(F.try_divide(F.col("confidence_score"), F.col("chunks_retrieved")), F.lit(0.0))
    rows = _sound(metrics).withColumn("efficiency", F.when(F.col("chunks_retrieved") > 0, efficiency).otherwise(0.0))
    low = lambda c: F.min(F.struct(F.col(c).alias("v"), "rag_name"))
    high = lambda c: F.min(F.struct((-F.col(c)).alias("v"), "rag_name"))
    found = rows.groupBy("query_id").agg(
        low("total_time").alias("fast"), high("total_time").alias("slow"), high("confidence_score").alias("sure"), low("confidence_score").alias("unsure"), high("efficiency").alias("eff")
    )
    return found.select(
        "query_id",
        F.col("fast.rag_name").alias("fastest_system"),
        F.col("slow.rag_name").alias("slowest_system"),
        F.round(-F.col("slow.v") - F.col("fast.v"), DIGITS).alias("speed_difference"),
        F.col("sure.rag_name").alias("highest_confidence_system"),
        F.col("unsure.rag_name").alias("lowest_confidence_system"),
        F.round(-F.col("sure.v") - F.col("unsure.v"), DIGITS).alias("confidence_spread"),
        F.col("eff.rag_name").alias("most_efficient_system"),
        F.round(-F.col("eff.v"), DIGITS).alias("efficiency_score"),
    )


def aggregate(metrics: DataFrame) -> DataFrame:
    """(rag_name, metric, mean, std, min, max, median, count) with population deviation."""
    rows = _sound(metrics).select("rag_name", *[F.col(c).cast("double") for c in METRICS]).unpivot("rag_name", METRICS, "metric", "value")
    r = lambda c, name: F.round(c, DIGITS).alias(name)
    return rows.groupBy("rag_name", "metric").agg(
        r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"), r(F.min("value"), "min"), r(F.max("value"), "max"), r(F.median("value"), "median"), F.count("value").alias("count")
    )


def cube(metrics: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Measures by system, by ``kind`` of query, by both and over all, in one pass by grouping sets.

    ``level`` says by what a row is grouped: 'system_kind', 'system', 'kind' or
    'all'. Each of ``columns`` gives its mean and its median as ``mean_...``
    and ``median_...``; ``n`` counts rows. A system or kind that is null itself
    is told from one that is not grouped by the level.
    """
    r = lambda c, name: F.round(c, DIGITS).alias(name)
    rows = _sound(metrics).select(F.col("rag_name").alias("system"), F.col(kind).alias("kind"), *[F.col(c).cast("double") for c in columns])
    own = rows.cube("system", "kind").agg(
        F.grouping_id().alias("grouped"), F.count("*").alias("n"),
        *[r(F.avg(c), f"mean_{c}") for c in columns], *[r(F.median(c), f"median_{c}") for c in columns],
    )
    level = F.element_at(F.array(*map(F.lit, ("system_kind", "system", "kind", "all"))), F.col("grouped").cast("int") + 1)
    return own.select(level.alias("level"), "system", "kind", "n", *[f"{m}_{c}" for c in columns for m in ("mean", "median")])


def summary(metrics: DataFrame) -> DataFrame:
    """(rag_name, mean_time, mean_confidence, queries_per_second, win_rate, n) over all systems with any sound row."""
    won = winners(metrics)
    total = metrics.select("query_id").distinct().agg(F.count("*").alias("queries"))
    wins = won.groupBy(F.col("winner").alias("rag_name")).agg(F.count("*").alias("wins"))
    own = _sound(metrics).groupBy("rag_name").agg(F.avg("total_time").alias("mean_time"), F.avg("confidence_score").alias("mean_confidence"), F.count("*").alias("n"))
    return own.join(wins, "rag_name", "left").crossJoin(F.broadcast(total)).select(  # one row
        "rag_name",
        F.round("mean_time", DIGITS).alias("mean_time"),
        F.round("mean_confidence", DIGITS).alias("mean_confidence"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.col("mean_time")), F.lit(0.0)), DIGITS).alias("queries_per_second"),
        F.round(F.coalesce("wins", F.lit(0)) / F.greatest("queries", F.lit(1)), DIGITS).alias("win_rate"),
        "n",
    )


def rankings(metrics: DataFrame) -> DataFrame:
    """(metric, rag_name, value, rank): overall score, then each metric by its mean; no shared ranks, ties by name."""
    # One row per system: a window over all of them is small.
    slowest = F.max("mean_time").over(Window.partitionBy())
    overall = summary(metrics).select(
        F.lit("overall").alias("metric"),
        "rag_name",
        F.round(F.when(slowest > 0, 0.3 * (1 - F.col("mean_time") / slowest)).otherwise(0.0) + 0.4 * F.col("mean_confidence") + 0.3 * F.col("win_rate"), DIGITS).alias("value"),
    )
    means = aggregate(metrics).filter(F.col("metric").isin(list(RANKED))).select("metric", "rag_name", F.col("mean").alias("value"))
    rising = F.when(F.col("metric") == "total_time", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("metric").orderBy(rising, "rag_name")
    return overall.unionByName(means).withColumn("rank", F.row_number().over(order))


def last_comparisons(metrics: DataFrame, order_by: str = "query_id", n: int = 10) -> DataFrame:
    """The metrics of the last n queries, newest first, with their winners."""
    last = metrics.select(order_by).distinct().orderBy(F.col(order_by).desc()).limit(n)
    return metrics.join(last, order_by, "left_semi").join(winners(metrics), "query_id", "left").orderBy(F.col(order_by).desc(), "rag_name")


def report(metrics: DataFrame) -> dict[str, DataFrame]:
    """All tables of a comparison report."""
    return {"aggregate": aggregate(metrics), "summary": summary(metrics), "rankings": rankings(metrics), "comparisons": last_comparisons(metrics), "analysis": analysis(metrics)}


def charts(metrics: DataFrame, answers: DataFrame) -> DataFrame:
    """What a chart of each query needs: metrics and the beginning of each response."""
    shown = answers.select("rag_name", "query_id", preview(F.col("response"), 500).alias("response_preview"))
    return metrics.join(shown, ["rag_name", "query_id"], "left")
