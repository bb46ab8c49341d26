"""Text functions as columns.

White space and word characters are written as explicit Unicode classes, so
that results do not depend on a regex engine's defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a character class without its brackets.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
#: What cleaning keeps: word characters, white space and plain punctuation.
_DROPPED = rf"[^\p{{L}}\p{{N}}_{SPACE}.,!?;:\-()\[\]{{}}\"'/]"
#: Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", " "]
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """One blank for each run of white space, then unusual characters dropped, then stripped; null gives empty.

    Dropping comes second, so blanks on both sides of a dropped character stay two.
    """
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " ")
    return strip(F.regexp_replace(blanks, _DROPPED, ""))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Number of tokens by a tokenizer file, without special tokens; without a file, a quarter of the characters. Null is empty."""
    if tokenizer is not None:

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            library = _tokenizer(tokenizer)
            for texts in batches:
                yield pd.Series([len(e.ids) for e in library.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

        return count(text)
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("int")


def truncate(text: Column, max_tokens: int, tokenizer: str | None = None) -> Column:
    """The text if its number of tokens is within the limit, else its first tokens (characters, by the estimate) up to it."""
    if tokenizer is not None:

        @F.pandas_udf("string")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            library = _tokenizer(tokenizer)
            for texts in batches:
                found = library.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
                yield pd.Series(
                    [t if t is None or len(e.ids) <= max_tokens else library.decode(e.ids[:max_tokens], skip_special_tokens=False) for t, e in zip(texts, found, strict=True)],
                    dtype=object,
                )

        return cut(text)
    return F.when(token_count(text) <= max_tokens, text).otherwise(F.substring(text, 1, max_tokens * CHARS_PER_TOKEN))


def preview(text: Column, size: int = 200) -> Column:
    """The first characters, with dots if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, stripped, none empty; the ends themselves go."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def split_text(text: Column, separators: list[str] | None = None, max_length: int | None = None) -> Column:
    """Split pieces longer than ``max_length`` (all, if it is None) at each separator in turn."""
    pieces = F.filter(F.array(text), lambda p: p != "")
    for separator in SEPARATORS if separators is None else separators:
        cut = lambda p: F.filter(F.transform(F.split(p, rf"\Q{separator}\E"), strip), lambda s: s != "")  # noqa: B023, E731
        pieces = F.flatten(
            F.transform(pieces, lambda p: F.when(F.length(p) <= max_length, F.array(p)).otherwise(cut(p)) if max_length else cut(p))  # noqa: B023
        )
    return F.filter(pieces, lambda p: strip(p) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of both, lower-cased; 0 where either is empty."""
    one, two = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(one, two)), F.size(F.array_union(one, two))), F.lit(0.0))


def normalized_name(name: Column) -> Column:
    """An entity's name for grouping: lower case, hyphens and underscores as blanks."""
    return F.translate(strip(F.lower(name)), "-_", "  ")


def document_id(path: Column, content: Column) -> Column:
    """A stable id from the hashes of path and content."""
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 8)
    return F.concat(F.lit("doc_"), short(path), F.lit("_"), short(content))


def summary(text: Column) -> Column:
    """Extractive summary: short texts whole, else two sentences and the first heading-like line not in them."""
    parts = F.split(text, r"\. ")
    first = F.slice(parts, 1, 2)
    marked = lambda s: s.startswith("#") | s.startswith("**") | (s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}"))
    lines = F.transform(F.split(text, "\n"), strip)
    heading = F.filter(lines, lambda s: marked(s) & ~F.contains(F.array_join(first, " "), s))
    joined = F.array_join(F.concat(first, F.slice(heading, 1, 1)), ". ")
    return F.when(F.size(parts) <= 3, text).otherwise(
        F.when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit(".")))
    )
