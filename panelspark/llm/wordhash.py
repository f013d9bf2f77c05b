"""Words of UTF-8 texts and 64-bit hashes of words and word n-grams, vectorised over bytes.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: digits, a-z and all
characters beyond ASCII.  In UTF-8 that is a property of single bytes, so the texts of a batch are
cut into words without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from panelspark.llm.common import byte_slices

BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
PIECE = 1 << 18  # bytes whose running sums are held at a time
LONG = 1 << 22  # a text of more bytes is cut into words piece by piece
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, up to PIECE."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(PIECE + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _hash_words(letters: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, from running sums over one piece of the bytes after the other."""
    power, inverse = _power_tables()
    value = np.zeros(len(first), np.uint64)
    sums = np.zeros(PIECE + 1, np.uint64)
    for begin in range(0, len(letters), PIECE):
        piece = letters[begin : begin + PIECE]
        n = len(piece)
        a = int(np.searchsorted(end, begin, side="right"))
        b = int(np.searchsorted(first, begin + n, side="left"))
        if a == b:
            continue
        np.cumsum(piece * power[:n], out=sums[1 : n + 1])
        s = np.maximum(first[a:b] - begin, 0)
        part = (sums[np.minimum(end[a:b] - begin, n)] - sums[s]) * inverse[s]
        if first[a] < begin:  # the word goes on from the piece before
            part[0] *= np.uint64(pow(BASE, int(begin - first[a]), 1 << 64))
        value[a:b] += part
    return mix(value)


class Words:
    """Words of a run of texts: byte ranges, hashes, and the text each belongs to."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        begin = int(starts[0])
        self.bytes = _LOWER[raw[begin : int(starts[-1])]]
        offsets = starts - begin
        n_texts, size = len(offsets) - 1, len(self.bytes)
        inside = self.bytes != 0
        cut = np.zeros(size + 1, bool)
        cut[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:size]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:size]
        self.first, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = _hash_words(self.bytes, self.first, self.end)
        self.text = np.searchsorted(offsets, self.first, side="right") - 1
        self.count = np.bincount(self.text, minlength=n_texts)
        self.base = np.concatenate([[0], np.cumsum(self.count)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of their first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = self.hash[:n].copy()
        for t in range(1, k):
            value *= np.uint64(STEP)
            value += self.hash[t : t + n]
        whole = np.flatnonzero(self.text[:n] == self.text[k - 1 : k - 1 + n])
        return mix(value[whole] + np.uint64(k)), whole

    def word(self, i: int) -> str:
        return self.bytes[self.first[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _word_end(raw: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on that is inside no word."""
    while at < stop:
        outside = np.flatnonzero(_LOWER[raw[at : min(stop, at + 4096)]] == 0)
        if len(outside):
            return at + int(outside[0])
        at = min(stop, at + 4096)
    return stop


def _word_begin(raw: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on that is inside a word."""
    while at < stop:
        inside = np.flatnonzero(_LOWER[raw[at : min(stop, at + 4096)]])
        if len(inside):
            return at + int(inside[0])
        at = min(stop, at + 4096)
    return stop


def word_pieces(
    raw: np.ndarray, starts: np.ndarray, before: int = 0, after: int = 0, size: int = LONG
) -> Iterator[tuple[int, int, Words, int, int, int]]:
    """(i, j, words, offset, own, end): the words of the texts ``i`` to ``j``, a piece of a long text at a time.

    Runs of texts of up to 512 KB, and single texts of up to ``size`` bytes, are one piece.  A longer text
    comes in pieces that end between words and also hold the ``before`` words before them and the
    ``after`` words behind them, as far as the text has them.  The words ``own`` to ``end`` are the piece's
    own; ``offset`` is the place in the text of the piece's first word.
    """
    for i, j in byte_slices(starts):
        begin, stop = int(starts[i]), int(starts[j])
        if stop - begin <= size or j - i > 1:
            words = Words(raw, starts[i : j + 1])
            yield i, j, words, 0, 0, len(words.hash)
            continue
        firsts: list[int] = []  # where the last `before` words begin
        done, at = 0, begin
        while at < stop:
            cut = _word_end(raw, min(stop, at + size // 4), stop)
            upto = cut
            for _ in range(after):
                upto = _word_end(raw, _word_begin(raw, upto, stop), stop)
            lead = firsts[0] if firsts else at
            words = Words(raw, np.array([lead, upto]))
            own = int(np.searchsorted(words.first, at - lead, side="left"))
            end = int(np.searchsorted(words.first, cut - lead, side="left"))
            yield i, j, words, done - own, own, end
            done += end - own
            if before:
                firsts = (words.first[max(0, end - before) : end] + lead).tolist()
            at = cut
