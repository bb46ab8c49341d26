"""Marginal word probabilities over all segmentations into pieces of an existing vocabulary.

A word is read as the word mark and its characters. Its lattice has an arc for
every piece that matches somewhere in it, and for a character outside the
vocabulary an arc of the pieces of its UTF-8 bytes. A forward recursion in log
space adds up all paths. Words of one length are computed together; a word too
long for that is read a stretch at a time, with a band of as many positions
held as the longest piece has. ``expected`` adds the backward recursion, for
learning the probabilities of pieces from words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MARK = "▁"
BATCH_CELLS = 1 << 20
STRETCH = 1 << 12  # characters of a very long word that are counted together
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
FIRST_BITS = 20
_REST = np.uint64(64 - FIRST_BITS)
LEAST = -500.0  # log probability that a double and the products of two leave room for


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer."""
    mixed = (hashes ^ (codes + np.uint64(1))) * _PRIME
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX


@dataclass
class Vocabulary:
    """Pieces in order of hash, with the prior that the vocabulary's own scores give them."""

    pieces: list[str]
    hashes: np.ndarray
    prior: np.ndarray  # probabilities of the pieces, then of the 256 bytes
    longest: int

    def __post_init__(self) -> None:
        self.begun = np.zeros(1 << FIRST_BITS, bool)  # whether a piece's hash begins with these bits
        self.begun[self.hashes >> _REST] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1; most strings are no piece and are told by the first bits."""
        out = np.full(hashes.shape, -1, np.int64)
        some = np.flatnonzero(self.begun[(hashes >> _REST).view(np.int64)])
        own = hashes.ravel()[some]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        out.ravel()[some] = np.where(self.hashes[at] == own, at, -1)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a sentencepiece model and turn its scores into probabilities.

    The scores of the vocabulary used here are minus the rank at which a piece
    was merged, not logarithms. As frequencies of words fall about as one over
    the rank, a piece of score s weighs 1 / (10 + largest score - s); the
    weights, scaled to sum to one less a ten-thousandth for the bytes, are the
    probabilities of the lattice's arcs.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    scores = np.array([model.get_score(i) for i in ids])
    hashes = np.zeros(len(pieces), np.uint64)
    for size in sorted({len(p) for p in pieces}):
        own = [i for i, p in enumerate(pieces) if len(p) == size]
        codes = _codes([pieces[i] for i in own])
        value = np.zeros(len(own), np.uint64)
        for k in range(size):
            value = _extend(value, codes[:, k])
        hashes[own] = value
    order = np.argsort(hashes)
    weight = 1 / (10 + scores.max() - scores[order])
    prior = np.concatenate([weight / weight.sum() * (1 - 1e-4), np.full(256, 1e-4 / 256)])
    return Vocabulary([pieces[i] for i in order], hashes[order], prior, max(map(len, pieces)))


class Lattice:
    """Lattices under piece probabilities: pieces, then bytes, then the end of a text; together they sum to 1."""

    def __init__(self, vocabulary: Vocabulary, probabilities: np.ndarray):
        self.vocabulary = vocabulary
        with np.errstate(divide="ignore"):
            self.log = np.log(probabilities)

    def _byte_arcs(self, chars: np.ndarray) -> np.ndarray:
        """Log probabilities of characters spelt in bytes."""
        first = len(self.vocabulary.pieces)
        spelt = [chr(int(c)).encode("utf-8", "surrogatepass") for c in chars]
        return np.array([sum(self.log[first + b] for b in s) for s in spelt])

    def _batches(self, words: list[str]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """Positions and code points of words of one length, a bounded number of cells at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b or self._is_long(int(sizes[order[a]])):
                continue
            step = max(1, BATCH_CELLS // ((int(sizes[order[a]]) + 1) * self.vocabulary.longest))
            for at in range(a, b, step):
                own = order[at : min(b, at + step)]
                yield own, _codes([MARK + words[i] for i in own])

    def _arcs(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Per arc length from 1: piece numbers and log probabilities by (start, word); and the characters spelt in bytes.

        Such a character's arc has number -2 - i, where i is its place among them.
        """
        rows, size = codes.shape
        columns = np.ascontiguousarray(codes.T)
        value = np.zeros((size, rows), np.uint64)
        numbers, logs = [], []
        spelt = np.zeros(0, np.uint64)
        for k in range(1, min(size, self.vocabulary.longest) + 1):
            value = _extend(value[: size - k + 1], columns[k - 1 :])
            piece = self.vocabulary.find(value)
            log = np.full(piece.shape, -np.inf)
            there = piece >= 0
            log[there] = self.log[piece[there]]
            if k == 1 and (piece < 0).any():
                spelt, which = np.unique(columns[piece < 0], return_inverse=True)
                log[piece < 0] = self._byte_arcs(spelt)[which]
                piece[piece < 0] = -2 - which
            numbers.append(piece)
            logs.append(log)
        return numbers, logs, spelt

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        """Log of the sum of exponentials."""
        stacked = np.stack(terms)
        top = stacked.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(stacked - safe).sum(axis=0)) + safe

    def _forward(self, logs: list[np.ndarray], size: int, rows: int) -> np.ndarray:
        alpha = np.full((size + 1, rows), -np.inf)
        alpha[0] = 0
        for end in range(1, size + 1):
            alpha[end] = self._sum([alpha[end - k] + logs[k - 1][end - k] for k in range(1, min(end, len(logs)) + 1)])
        return alpha

    def _is_long(self, size: int) -> bool:
        """Whether one word of so many characters has too many cells to be held."""
        return (size + 1) * self.vocabulary.longest > BATCH_CELLS

    def _marginal_of_long(self, word: str, stretch: int = 1 << 12) -> float:
        """Log probability of one word of any length, in memory that its length does not add to."""
        size, band = len(word) + 1, self.vocabulary.longest
        reached = np.full(stretch + band, -np.inf)  # log probability of what ends at each position of the stretch
        reached[0] = 0
        for at in range(0, size, stretch):
            start = MARK if at == 0 else ""
            codes = _codes([start + word[max(0, at - 1) : at + stretch + band - 1 - len(start)]])
            _, logs, _ = self._arcs(codes)
            n = min(stretch, size - at)
            arcs = np.full((n, band), -np.inf)
            for k, log in enumerate(logs):
                arcs[: len(log), k] = log[:n, 0]
            for i in range(n):
                ahead = reached[i + 1 : i + 1 + band]
                np.logaddexp(ahead, reached[i] + arcs[i, : len(ahead)], out=ahead)
            last = reached[n]
            reached = np.concatenate([reached[stretch:], np.full(stretch, -np.inf)])
        return float(last)

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, summed over its segmentations."""
        out = np.zeros(len(words))
        for i, word in enumerate(words):
            if self._is_long(len(word)):
                out[i] = self._marginal_of_long(word)
        for own, codes in self._batches(words):
            _, logs, _ = self._arcs(codes)
            plain = self._plain(logs)
            if plain.any():
                values = [np.exp(log[:, plain]) for log in logs]
                out[own[plain]] = np.log(self._forward_plain(values, codes.shape[1])[-1])
            if not plain.all():
                logs = [log[:, ~plain] for log in logs]
                out[own[~plain]] = self._forward(logs, codes.shape[1], logs[0].shape[1])[-1]
        return out

    @staticmethod
    def _plain(logs: list[np.ndarray]) -> np.ndarray:
        """Words whose sums can be made of probabilities themselves: the path of single characters, a part of each sum, is not too small for a double."""
        return logs[0].sum(axis=0) > LEAST

    @staticmethod
    def _forward_plain(values: list[np.ndarray], size: int) -> np.ndarray:
        """``_forward`` of probabilities."""
        alpha = np.zeros((size + 1, values[0].shape[1]))
        alpha[0] = 1
        for end in range(1, size + 1):
            own = alpha[end]
            for k in range(1, min(end, len(values)) + 1):
                own += alpha[end - k] * values[k - 1][end - k]
        return alpha

    def _shares(self, logs: list[np.ndarray], size: int) -> list[np.ndarray]:
        """Per arc length the probability that a segmentation has the arc, by (start, word)."""
        shares = [np.zeros(log.shape) for log in logs]
        plain = self._plain(logs)
        if plain.any():
            values = [np.exp(log[:, plain]) for log in logs]
            forward = self._forward_plain(values, size)
            backward = np.zeros_like(forward)
            backward[size] = 1
            for start in range(size - 1, -1, -1):
                own = backward[start]
                for k in range(1, min(size - start, len(values)) + 1):
                    own += values[k - 1][start] * backward[start + k]
            for k, (share, value) in enumerate(zip(shares, values, strict=True), 1):
                share[:, plain] = forward[: size - k + 1] / forward[-1] * value * backward[k:]
        if not plain.all():
            rest = [log[:, ~plain] for log in logs]
            forward = self._forward(rest, size, rest[0].shape[1])
            backward = np.full_like(forward, -np.inf)
            backward[size] = 0
            for start in range(size - 1, -1, -1):
                backward[start] = self._sum([rest[k - 1][start] + backward[start + k] for k in range(1, min(size - start, len(rest)) + 1)])
            for k, (share, log) in enumerate(zip(shares, rest, strict=True), 1):
                share[:, ~plain] = np.exp(forward[: size - k + 1] + log + backward[k:] - forward[-1])
        return shares

    def _count(self, codes: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of pieces and bytes in strings of one length."""
        numbers, logs, spelt = self._arcs(codes)
        size = codes.shape[1]
        first = len(self.vocabulary.pieces)
        for k, (number, log, shares) in enumerate(zip(numbers, logs, self._shares(logs, size), strict=True), 1):
            there = np.isfinite(log)
            share = shares[there]
            arc = number[there]
            into[:first] += np.bincount(arc[arc >= 0], share[arc >= 0], minlength=first)
            for c, n in zip(spelt, np.bincount(-2 - arc[arc < 0], share[arc < 0], minlength=len(spelt)) if k == 1 else (), strict=False):
                for b in chr(int(c)).encode("utf-8", "surrogatepass"):
                    into[first + b] += n

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece and byte is used in these words, over all segmentations by their probability; very long words by stretches."""
        out = np.zeros(len(self.log))
        for word in words:
            if self._is_long(len(word)):
                for at in range(0, len(word) + 1, STRETCH):
                    self._count(_codes([(MARK + word)[at : at + STRETCH]]), out)
        for _, codes in self._batches(words):
            self._count(codes, out)
        return out
