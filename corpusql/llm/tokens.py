"""Token ids and token counts of whole texts with a public tokenizer.

Texts are encoded in Arrow batches. A batch is cut into groups of about
``GROUP_BYTES`` bytes, and a text longer than ``PIECE_CHARS`` characters is
encoded in pieces cut at safe boundaries: where white space follows another
character, an ASCII letter adjoins a digit, or common punctuation other than an
apostrophe or a bar follows a letter or digit. For the ``.json`` vocabularies no token reaches
across such a place, no special string holds one and no look-ahead of the
splitting pattern sees past it, so the pieces' tokens are the text's.
Where the vocabulary's rank table is known, plain texts take that (``Ids``)
and all others the library; the numbers are the library's either way.

Defined results: a null text counts as empty and has no tokens; blank texts
are encoded like any other; special strings inside texts are handled as the
library does by default; of a very long text only a run without any safe
boundary is encoded whole; rows with null or equal ids and repeated rows are
counted each for itself, alike; an empty table gives an empty result; other
columns, whatever their names and the case of these, are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.columns import quoted

#: Rank tables of public ``.json`` vocabularies.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
GROUP_BYTES = 1 << 21
PIECE_CHARS = 1 << 15

_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^\W_])(?=[!-&(-/:-@\[-^`{}~、。！，：；？])")


def tokenizer_file(name_or_path: str) -> str:
    """A file's place: a path as it is, a bare name within the public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text into pieces of about ``size`` characters at safe boundaries."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's to share out
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def piece_tokenizer(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def lengths(texts: list[str], sizes: list[int], path: str) -> list[int]:
    """Number of tokens of each text, whose bytes are ``sizes``, in groups of about ``GROUP_BYTES`` bytes."""
    if path.endswith(".model"):
        # Word pieces may reach across any white space; these texts are encoded whole.
        return [len(ids) for ids in piece_tokenizer(path).encode(texts, num_threads=1)] if texts else []
    tokenizer = json_tokenizer(path)
    counts = [0] * len(texts)
    group: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, encoding in zip(owners, tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
            counts[owner] += len(encoding)
        group.clear()
        owners.clear()

    for i, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        pieces = safe_pieces(text)
        for piece in pieces:
            group.append(piece)
            owners.append(i)
            held += size if len(pieces) == 1 else len(piece.encode())
            if held >= GROUP_BYTES:
                flush()
                held = 0
    flush()
    return counts


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    max_tokens: int = 512,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every row.

    ``tokenizer`` is a path or the name of a public tokenizer: ``.json`` for
    the tokenizers library, ``.model`` for sentencepiece. Without a shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            n = counted([t or "" for t in batch.column(1).to_pylist()], sizes, tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > max_tokens)
    )


class Ids:
    """Token ids of texts as arrays, equal to the ``.json`` tokenizer's.

    Texts whose characters all lie below ``PLAIN`` take the rank table of the
    same vocabulary, which is several times faster; there the two libraries'
    character classes agree, which tests check for every such character and on
    long random texts of them.
    All other texts, and those with long runs of white space or a special
    string, take the ``.json`` tokenizer itself.
    """

    PLAIN = 0x250
    _odd = re.compile(rf"[^\x00-{chr(PLAIN - 1)}]|\s{{200}}|\S{{2000}}|<\|")

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        self.tokenizer = json_tokenizer(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def is_plain(self, text: str) -> bool:
        return not self._odd.search(text)

    def plain_length(self, text: str) -> int:
        """Number of ids of a plain text."""
        return sum(len(self.fast.encode_ordinary(piece)) for piece in safe_pieces(text))

    def encode(self, text: str) -> np.ndarray:
        if not self.is_plain(text):
            encode = lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            encode = self.fast.encode_ordinary
        pieces = [np.asarray(encode(piece), dtype="<u4") for piece in safe_pieces(text)]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces)


@lru_cache(maxsize=2)
def ids(json_name: str, ranks_name: str) -> Ids:
    return Ids(tokenizer_file(json_name), tokenizer_file(ranks_name))


def counted(texts: list[str], sizes: list[int], tokenizer: str) -> list[int]:
    """Number of tokens of each text, whose bytes are ``sizes``: plain texts by the vocabulary's rank table, if it has one, others by the library."""
    path, ranks = tokenizer_file(tokenizer), RANKS.get(tokenizer)
    if ranks is None:
        return lengths(texts, sizes, path)
    own = ids(tokenizer, ranks)
    counts = [own.plain_length(text) if own.is_plain(text) else -1 for text in texts]
    others = [i for i, n in enumerate(counts) if n < 0]
    for i, n in zip(others, lengths([texts[i] for i in others], [sizes[i] for i in others], path), strict=True):
        counts[i] = n
    return counts
