import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, size string, Count double, "
    "score string, suspect int, draw string, n_copies int, block string, keep_id string, kept boolean, word string, "
    "suspect_block int, suspect_bitmap string, FP int, Draws int, Node string, Prints int, Plan string, Goes int, Copy int, Sha string, Best int, `a.b` int"
)


def rows_of(texts, first=0):
    """Rows with clashing extra columns for (text, lang, source) triples or plain texts."""
    out = []
    for i, t in enumerate(texts):
        text, lang, source = t if isinstance(t, tuple) else (t, "en", "s")
        out.append((first + i, text, lang, source, 7, 1, "x", 0.5, "s", 1, "d", 3, "b", "k", True, "w", 4, "m", 5, 6, "n", 7, "p", 8, 9, "h", 10, 11))
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows and equal ids."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "δέλτα", "漢字"]) for _ in range(60_000))
    texts = ["", None, "   \n\t ", "A b C", "a B c", "a b c d", long, long.upper(), "x" * 70_000, "MIT License", "!!! 123 ???", ("ß Ü é", None, None)]
    rows = rows_of(texts)
    width = len(rows[0])
    rows += [rows[3], rows[3], (None, *rows[4][1:]), (None,) * width, (None, "A b C", *[None] * (width - 2))]
    return make(rows)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
