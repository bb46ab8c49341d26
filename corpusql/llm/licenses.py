"""Licence scan: TF-IDF cosine to templates, then inheritance by path, in DataFrame functions only.

A text is read in sentences (of its lines) and as a whole. Each is compared
with templates (notices, lines of standard
headers, SPDX lines and bodies of licences) by the cosine of sparse TF-IDF vectors; inverse
document frequencies of the templates' terms are counted over all documents.
With ``every_term`` so are those of the other terms, first bounded from below
(no term weighs less than one that every document has), then counted for the
texts and sentences that the bound leaves; without it other terms weigh as one
that no document has, as in the SQL. A sentence's best template at
``THRESHOLD`` or more is the file's own licence. A file that as a whole is
that near a template, or that bears a licence file's name, licenses its
directory. Files without a licence of their own take that of the nearest
ancestor directory that has one.

Before any word is put in a row of its own, sentences are filtered by prefix:
terms of high weight of each template are its anchors, rare ones first, as many as leave
less than ``THRESHOLD`` squared of its squared length, so that a sentence
without any anchor cannot come near it. The filter drops no match.

Defined results: null and empty texts have no licence of their own; ties go to
the first licence by name, then the smaller path; of several licence files of
one directory the nearest to its template counts, ties to the smaller path; a
null path is in no directory and inherits nothing; rows with null or equal ids
or paths and repeated rows are files of their own; very long texts are read
whole, in sentences and as one; an empty table gives an empty result; other
columns, whatever their names and the case of these, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import quoted
from corpusql.llm.license_texts import BODIES

THRESHOLD = 0.8

#: Licence identifiers and the names that notices use for them.
NAMES = [
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
]
#: How notices begin.
NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}"]
#: Lines by which files name their licence.
_FREE = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
HEADERS = [
    *(("SPDX-License-Identifier: " + name, name) for name, _ in NAMES),
    *((f"SPDX-License-Identifier: {name}-{kind}", name) for name, _ in NAMES if "GPL" in name for kind in ("only", "or-later")),
    ('Licensed under the Apache License, Version 2.0 (the "License")', "Apache-2.0"),
    (_FREE.format("program", "General Public License", 2), "GPL-2.0"),
    (_FREE.format("program", "General Public License", 3), "GPL-3.0"),
    (_FREE.format("library", "Lesser General Public License", 3), "LGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
]

#: File names that mark a licence file whatever else it holds.
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"

_SPLIT = re.compile(r"[^a-z0-9]+")
#: The same for columns: letters and digits of any script make terms.
_TERM_GAPS = r"[^\p{L}\p{N}]+"
_SENTENCE_GAPS = r"\n|(?<=[.!?])\s+"


def terms(text: Column) -> Column:
    """Lower-case terms of a text, repeats included."""
    return F.filter(F.split(F.lower(text), _TERM_GAPS), lambda t: t != "")


def templates() -> list[tuple[str, str]]:
    """(licence, text): a notice for each name and way to begin, headers, and bodies."""
    notices = [(name, notice.format(words)) for name, words in NAMES for notice in NOTICES]
    return [*notices, *((name, line) for line, name in HEADERS), *BODIES.items()]


def _term_counts(text: str) -> Counter[str]:
    return Counter(t for t in _SPLIT.split(text.lower()) if t)


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float, int]:
    """idf of each term of the vocabulary over all texts, that of a term no text has, and the number of texts."""
    found = (
        docs.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    seen = {r["term"]: r["n"] for r in found.collect()}  # a row for each term of the vocabulary at most
    total = docs.count()
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {t: idf(seen.get(t, 0)) for t in vocabulary}, idf(0), total


def anchors(weights: dict[str, float], threshold: float, common: set[str]) -> set[str]:
    """Terms of a unit vector without which the cosine stays below the threshold, common ones only where the others are too few."""
    left, chosen = 1.0, set()
    for term, w in sorted(weights.items(), key=lambda x: (x[0] in common, -x[1], x[0])):
        if left < threshold**2 * (1 - 1e-9):
            break
        chosen.add(term)
        left -= w * w
    return chosen


def counted(segments: DataFrame) -> DataFrame:
    """(row, part, term, tf) of segments with id columns row, part and an array of terms."""
    return segments.select("row", "part", F.explode("terms").alias("term")).groupBy("row", "part", "term").agg(F.count("*").alias("tf"))


def further_frequencies(words: DataFrame, idf: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """(term, idf) over all texts of the terms of ``words`` that the table ``idf`` lacks."""
    new = scratch.table(words.select("term").distinct().join(idf, "term", "left_anti"), "terms")
    if new.isEmpty():
        return idf.limit(0)
    # A row for each distinct term and task is shuffled; the size of the written terms decides how they are met.
    found = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(new, "term").groupBy("term")
    weight = F.log((1 + F.lit(total)) / (1 + F.col("n"))) + 1
    return scratch.table(found.agg(F.count("*").alias("n")).select("term", weight.alias("idf")), "frequencies")


def similar(words: DataFrame, weights: DataFrame, idf: DataFrame, other: float) -> DataFrame:
    """Best (licence, similarity) of each segment of ``words``, whose terms without idf weigh ``other``."""
    # Sizes are left to Spark where the table has more than the templates' terms.
    valued = words.join(idf, "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other)))
    lengths = valued.groupBy("row", "part").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    # The templates' weights are a fixed table of some thousand rows.
    products = (
        valued.join(F.broadcast(weights), "term")
        .groupBy("row", "part", "template", "license")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("product"))
    )
    return (
        products.join(lengths, ["row", "part"])
        .withColumn("similarity", F.round(F.col("product") / F.col("length"), 6))
        .groupBy("row", "part")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best"))
        .select("row", "part", (-F.col("best.s")).alias("similarity"), "best.license")
    )


def _inherited(found: DataFrame) -> DataFrame:
    """(directory, license, similarity, path) of the nearest licensed directory at or above each directory with files."""
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    licensed = (
        found.filter(F.col("licenses_directory"))
        .groupBy(directory.alias("licensed"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("by"))
    )
    parts = F.split("directory", "/")
    above = (
        found.filter(F.col("path").isNotNull())
        .select(directory.alias("directory"))
        .distinct()
        .select("directory", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
        .withColumn("licensed", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    )
    return (
        above.join(licensed, "licensed")
        .groupBy("directory")
        .agg(F.max_by("by", "depth").alias("by"))
        .select("directory", F.col("by.license").alias("up_license"), (-F.col("by.s")).alias("up_similarity"), F.col("by.path").alias("up_path"))
    )


def license_scan(
    docs: DataFrame, id_col: str, text_col: str, path: Column, threshold: float = THRESHOLD, every_term: bool = False
) -> DataFrame:
    """One row per file: doc_id, path, license, similarity, origin (own, inherited or null) and from_path."""
    spark = docs.sparkSession
    slim = docs.select(quoted(id_col).alias("doc_id"), path.alias("path"), quoted(text_col).alias("text"))
    forms = [(number, license_, _term_counts(notice)) for number, (license_, notice) in enumerate(templates())]
    vocabulary = sorted({t for _, _, tf in forms for t in tf})
    idf, other, total = inverse_frequencies(slim, vocabulary)
    # More than one text in a hundred has these; which terms are anchors decides only how many texts are compared.
    common = {t for t, w in idf.items() if w < 1 + math.log(100)}
    rows, anchored = [], set()
    for number, license_, tf in forms:
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        unit = {t: n * idf[t] / length for t, n in tf.items()}
        anchored |= anchors(unit, threshold, common)
        rows += [(number, license_, t, w) for t, w in unit.items()]
    weights = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    idf_table = spark.createDataFrame(list(idf.items()), "term string, idf double")
    # Terms are letters and digits, so a term stands in a text exactly where no such character adjoins it.
    anchor = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(anchored))})(?![\p{{L}}\p{{N}}])"
    sentences = F.filter(F.split(F.lower("text"), _SENTENCE_GAPS), lambda t: t.rlike(anchor))
    # Words are cut only in the few texts that hold an anchor.
    files = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", sentences.alias("sentences"), "text").select(
        "row",
        "doc_id",
        "path",
        F.transform("sentences", terms).alias("sentences"),
        F.when(F.size("sentences") > 0, terms(F.col("text"))).alias("whole"),
    )
    files = scratch.table(files, "files")
    segments = files.filter(F.size("sentences") > 0).select(
        "row", F.posexplode("sentences").alias("part", "terms")
    ).unionByName(
        files.filter(F.col("whole").isNotNull()).select("row", F.lit(-1).alias("part"), F.col("whole").alias("terms"))
    )
    near = counted(segments)
    if every_term:
        # Where other terms weigh the least possible, 1, similarity is an upper bound.
        bound = similar(near, weights, F.broadcast(idf_table), 1.0).filter(F.col("similarity") >= threshold - 1e-6)
        close = scratch.table(bound.select("row", "part"), "close")
        near = scratch.table(near.join(close, ["row", "part"], "left_semi"), "words")
        idf_table = idf_table.unionByName(further_frequencies(near, idf_table, slim, total))
    else:
        idf_table = F.broadcast(idf_table)
    near = scratch.table(similar(near, weights, idf_table, other).filter(F.col("similarity") >= threshold), "near")
    own = near.groupBy("row").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best"), F.min("part").alias("first")
    )
    found = (
        files.select("row", "doc_id", "path")
        .join(own, "row", "left")
        .select(
            "doc_id",
            "path",
            F.col("best.license").alias("license"),
            (-F.col("best.s")).alias("similarity"),
            ((F.col("first") == -1) | (F.col("best").isNotNull() & F.col("path").rlike(FILE_NAMES))).alias("licenses_directory"),
        )
    )
    found = scratch.table(found, "found")
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    up = _inherited(found)
    alone = F.col("license").isNull()
    return (
        found.join(up, directory == up["directory"], "left")
        .select(
            "doc_id",
            "path",
            F.coalesce("license", "up_license").alias("license"),
            F.coalesce("similarity", "up_similarity").alias("similarity"),
            F.when(~alone, "own").when(F.col("up_license").isNotNull(), "inherited").alias("origin"),
            F.when(~alone, F.col("path")).otherwise(F.col("up_path")).alias("from_path"),
        )
    )
