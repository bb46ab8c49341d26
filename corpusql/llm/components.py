"""Connected components of a table of links, by contraction.

In each round every node points to the node of least hash among itself and
its neighbours, links are replaced by links between those, and links within
one node and repeated links go. The hash changes with the round, so whatever
the shape of a component, a constant share of its nodes goes in each round on
average. Neighbours are reduced before the shuffle, so a node with very many
links reaches it as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm import scratch


def _simple(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``, a table of columns a and b; root is one node of the component."""
    links = scratch.table(_simple(links), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        turn = F.lit(len(steps))
        ranked = lambda name: F.struct(F.xxhash64(turn, F.col(name)).alias("h"), F.col(name).alias("n"))  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.table(
            both.groupBy("a")
            .agg(F.min(ranked("b")).alias("near"))
            .select(F.col("a").alias("node"), F.least("near", ranked("a"))["n"].alias("to")),
            "step",
        )
        steps.append(step)
        links = scratch.table(
            _simple(
                links.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
                .join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
                .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            ),
            "links",
        )
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps.pop().withColumnRenamed("to", "root")
    while steps:
        later = roots.select(F.col("node").alias("to"), F.col("root"))
        roots = steps.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
