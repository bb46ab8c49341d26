import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusql.llm import tokens
from corpusql.llm.packing import pack, pack_histogram, places
from corpusql.llm.tokens import Ids, ids, safe_pieces, token_counts

JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def real(text):
    return JSON.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(awkward, make):
    extra = make(rows_of(["a <|endoftext|> b", "tabs\t\t\tand   runs \n\n of blanks  ", "it's we'll I'D 12345 x9", "naïve     z"]))
    rows = awkward.unionByName(extra).collect()
    found = token_counts(awkward.unionByName(extra)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(real(r.text)), len(real(r.text)) > 512) for r in rows)
    assert Counter(map(tuple, found)) == want


def test_other_vocabularies(make):
    import sentencepiece

    texts = ["Hello world", "", "two  blanks"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r.n_tokens for r in token_counts(make(rows_of(texts)), tokenizer="piece_bpe_32k.model").collect()}
    assert found == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r.n_tokens for r in token_counts(make(rows_of(texts)), tokenizer="word_bpe_49k.json").collect()}
    assert found == {i: len(word.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9'.,  \n\té ſ漢"), max_size=60), st.integers(1, 9))
def test_pieces_have_the_texts_tokens(text, size):
    parts = safe_pieces(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in real(p)] == real(text)


WORD_JSON = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9'.,  \n\té ſ漢s5_|<>。!\u0301"), max_size=60), st.integers(1, 9))
def test_pieces_have_the_texts_tokens_in_words_with_ends(text, size):
    whole = WORD_JSON.encode(text, add_special_tokens=False).ids
    assert [i for p in safe_pieces(text, size) for i in WORD_JSON.encode(p, add_special_tokens=False).ids] == whole


def test_rank_table_agrees_on_long_texts():
    encoder, rng = ids("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), random.Random(8)
    kinds = ["abcdefgh", "ABCxyz", "0123456789", " ", "  \n\t", ".,;:!?-'\"()", "éüßøŁſƒɏ", "\x00\x1f\x7f\x85\xa0\xad"]
    words = [w.decode(errors="ignore") for w in (b" the", b" and", b"'s", b"'LL", b"http://", b"\r\n", b"1,000.00", b"...")]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(2_000, 8_000)):
            kind = rng.choice(kinds)
            parts.append(rng.choice(words) if rng.random() < 0.3 else "".join(rng.choice(kind) for _ in range(rng.randrange(1, 9))))
        text = "".join(parts)
        assert encoder.encode(text).tolist() == real(text)


def test_rank_table_agrees_on_every_plain_character():
    encoder = ids("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for code in range(Ids.PLAIN):
        c = chr(code)
        for text in (c, f"a{c}b", f" {c} {c}{c}", f"1{c}2", f"'{c}s", f"\n{c}\n", f"{c}'ll", f"Aa {c}Z  {c}"):
            assert encoder.encode(text).tolist() == real(text), (code, text)
    rng = random.Random(1)
    for _ in range(3_000):
        text = "".join(chr(rng.randrange(Ids.PLAIN)) if rng.random() < 0.3 else rng.choice("abc '.\n 12tls") for _ in range(rng.randrange(40)))
        assert encoder.encode(text).tolist() == real(text), text
    for text in ("x<|endoftext|>y", "漢字 and ab", " " * 500 + "a", "q" * 5_000):
        assert encoder.encode(text).tolist() == real(text)


def check_pack(df, size=2048):
    rows, found = df.collect(), pack(df, max_tokens=size).collect()
    whole = Counter()
    for r in rows:
        tokens = np.array([*real(r.text), 1], "<u4")
        whole[r.doc_id, len(tokens), zlib.crc32(tokens.tobytes())] += 1
    sequences = defaultdict(list)
    by_doc = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    want = Counter()
    for r in rows:
        tokens = np.array([*real(r.text), 1], "<u4")
        for at in range(0, len(tokens), size):
            piece = tokens[at : at + size]
            want[r.doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(tokens)] += 1
    assert by_doc == want
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places_ in sequences.values():
        at = 0
        for offset, length in sorted(places_):
            assert offset == at
            at += length
        assert at <= size
    assert set(sequences) == set(range(len(sequences)))
    return sequences, sum(r.length for r in found)


def test_round_trip_of_awkward_rows(awkward, nothing):
    check_pack(awkward)
    assert pack(nothing).count() == 0


def test_little_padding_and_hot_lengths(make, monkeypatch):
    monkeypatch.setattr("corpusql.llm.packing.RANK_GROUP", 10)
    rng = random.Random(2)
    texts = [" ".join(["word"] * (40 if rng.random() < 0.4 else rng.randrange(1, 150))) for _ in range(900)]
    sequences, tokens = check_pack(make(rows_of(texts)), 256)
    assert 1 - tokens / (256 * len(sequences)) < 0.02


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10_000), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = pack_histogram(histogram, 64)
    held = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            held[length] += n
    assert held == Counter(histogram)
    assert len(patterns) < 2_000
    assert {k: sum(1 for _ in v) > 0 for k, v in places(patterns).items()} == {k: True for k in histogram}


def test_plain_texts_are_counted_by_ranks_and_others_by_the_library(monkeypatch):
    texts = ["", "a plain text, with 12 words' ends\r\n\n  and tabs\t", "δέλτα", "漢字 and words", "<|endoftext|>x", " " * 300 + "x", "y" * 3_000, "é ÿ ɏ ß 1/2", "It's I'LL 'tis <b>x</b> " * 5_000]
    sizes, path = [len(t.encode()) for t in texts], tokens.tokenizer_file("byte_bpe_50k.json")
    library = tokens.json_tokenizer(path)
    asked, lengths = [], tokens.lengths
    monkeypatch.setattr(tokens, "lengths", lambda some, *rest: asked.extend(some) or lengths(some, *rest))
    assert tokens.counted(texts, sizes, "byte_bpe_50k.json") == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert asked == texts[2:7]
    assert tokens.counted(texts, sizes, path) == tokens.counted(texts, sizes, "byte_bpe_50k.json")
