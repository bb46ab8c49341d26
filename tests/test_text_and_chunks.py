import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusql.config import ChunkingConfig
from corpusql.functions import chunk as C
from corpusql.functions import text as T


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# A\n\n* b\tc_d  ", "A  b c_d"),  # neither headings nor bullets survive
        ("a & b", "a  b"),  # blanks first, then characters: two blanks stay
        ("Ünï 漢字   x!?(y)[z]{w}\"'/-", "Ünï 漢字 x!?(y)[z]{w}\"'/-"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_text(spark, text, expected):
    assert value(spark, T.clean_text, text) == expected


def test_text_functions(spark):
    assert value(spark, T.word_count, " a  b c ") == 3
    assert value(spark, T.token_count, "x" * 11) == 2
    assert value(spark, T.sentences, "One. Two!? ... Three") == ["One", "Two", "Three"]
    assert value(spark, lambda c: T.truncate(c, 2), "x" * 20) == "x" * 8
    assert value(spark, lambda c: T.preview(c, 3), "abcd") == "abc..."
    assert value(spark, lambda c: T.split_text(c, ["\n", " "], 5), "ab cd\nabc defg\n\nx") == ["ab cd", "abc", "defg", "x"]
    assert value(spark, lambda c: T.split_text(c), "a. b\n\nc") == ["a", "b", "c"]
    assert value(spark, T.normalized_name, " Machine-Learning_x ") == "machine learning x"
    assert value(spark, lambda c: T.jaccard(c, F.lit("the cat")), "The dog") == pytest.approx(1 / 3)
    assert value(spark, lambda c: T.jaccard(c, F.lit("")), "") == 0
    assert value(spark, lambda c: T.document_id(F.lit("/a"), c), "x").startswith("doc_")


def test_summaries(spark):
    assert value(spark, T.summary, "a. b. c") == "a. b. c"
    assert value(spark, T.summary, "a. b. c. d") == "a. b."
    assert value(spark, T.summary, "a. b. c. d\n# Head\n# Other") == "a. b. # Head."
    assert value(spark, T.summary, "a. b. c. d\nLOUD") == "a. b. LOUD."


def fixed(size=20, overlap=5, least=3, strategy="fixed_size"):
    return ChunkingConfig(strategy, size, overlap, least)


def test_fixed_size_drops_what_lies_before_the_next_run():
    text = "aaaa bbbb cccc dddd eeee ffff"
    # The first run ends at its last blank, and the next begins at 20 - 5 or there, whichever is later.
    assert C.fixed_size(text, fixed()) == ["aaaa bbbb cccc dddd", "eeee ffff"]
    short = "x" * 11 + " " + "y" * 40
    assert C.fixed_size(short, fixed()) == ["x" * 11, "y" * 20, "y" * 17]  # three of y are in no chunk
    assert C.fixed_size("z" * 45, fixed()) == ["z" * 20, "z" * 20, "z" * 5]
    assert C.fixed_size("   ", fixed()) == []


def test_overlapping_runs_share_characters():
    runs = C.overlapping("abcdefghij", fixed(4, 2))
    assert runs == ["abcd", "cdef", "efgh", "ghij"]


def test_semantic_packs_sentences_and_repeats_the_last():
    text = "Aa aa. Bb bb. Cc cc. Dd dd."
    assert C.semantic(text, fixed(11, 5, 1)) == ["Aa aa Bb bb", "Bb bb Cc cc", "Cc cc Dd dd"]
    assert C.semantic(text, fixed(11, 0, 1)) == ["Aa aa Bb bb", "Cc cc Dd dd"]
    assert C.semantic("Short. " + "L" * 50 + ". End", fixed(11, 5, 10)) == ["L" * 50]
    assert C.semantic("...", fixed()) == ["..."]


def test_recursive_goes_to_finer_separators():
    text = "para one\n\npara two is longer. it has parts. " + "w" * 25
    found = C.recursive(text, fixed(20, 0, 1))
    assert found == ["para one", "para two is longer", "it has parts", "w" * 20, "w" * 5]


def test_headings_and_paragraphs():
    text = "# One\nline a\nline b\n## Two\nline c"
    assert C.by_headings(text, fixed(100, 0, 1)) == ["# One\nline a\nline b", "## Two\nline c"]
    assert C.by_headings("# One\nline a\nline b", fixed(12, 0, 1)) == ["# One\nline a", "# One\nline b"]
    assert C.by_paragraphs("aaaa\n\nbbbb\n\ncccc", fixed(8, 1, 1)) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert C.structure_aware("aaaa\n\nbbbb", fixed(4, 0, 1)) == ["aaaa", "bbbb"]
    assert C.structure("# a\n\nb") == {"headings": 1, "paragraphs": 2, "lines": 3}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n#", max_size=200), st.integers(5, 40), st.integers(0, 4), st.sampled_from(["fixed_size", "recursive", "structure_aware", "semantic"]))
def test_chunks_keep_their_bounds(text, size, overlap, strategy):
    found = C._strategies[strategy](text, ChunkingConfig(strategy, size, overlap, 3))
    if strategy in ("fixed_size", "recursive"):
        assert all(len(c) <= size for c in found)
    if strategy != "fixed_size" and text.strip(" .!\n#"):
        assert all(len(c.strip()) > 0 for c in found)


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "  ")], "doc_id long, content string")
    rows = C.chunks(docs, ChunkingConfig("semantic", 8, 0, 1)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.chunk_position) for r in rows] == [("1_semantic_0", "One two", 0.0), ("1_semantic_1", "Three four", 0.5)]
    unknown = C.chunks(docs, ChunkingConfig("odd", 50, 0, 1)).first()
    assert unknown.strategy == "odd" and unknown.content == "One two. Three four."
    assert C.chunk_stats(C.chunks(docs.limit(0), ChunkingConfig())).count() == 0


def test_own_strategy(spark):
    C.add_strategy("lines", _lines)
    assert "lines" in C.strategies()
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, content string")
    assert [r.content for r in C.chunks(docs, ChunkingConfig("lines")).collect()] == ["a", "b"]


def _lines(text, config):
    return text.split("\n")


_lines.__module__ = "__main__"  # pickled by value: the executors do not have the tests


def test_tokens_by_a_tokenizer_file(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["", "one", "A longer text, with several words and numbers: 12345.", "naïve café 東京 " * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", T.token_count(F.col("text"), path).alias("n"), T.truncate(F.col("text"), 5, path).alias("cut")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert row.n == len(ids)
        assert row.cut == (text if len(ids) <= 5 else library.decode(ids[:5], skip_special_tokens=False))
