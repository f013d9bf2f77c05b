"""Token counts: count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches in a word; dynamic programming carries, for each
position, the best score and the number of pieces of the best way there.  No piece is built.

The result equals the unigram model of the ``tokenizers`` library over the same vocabulary, with its
metaspace cut: spaces become U+2581, which begins every word.  Its tie rules: at each position the
match that begins first wins unless a later one is strictly better; a character that no single piece
covers may be unknown at the smallest score minus 10, and is tried last; a run of unknown characters is
one unknown piece, or its UTF-8 bytes where the vocabulary has byte pieces.

A word's count does not depend on its neighbours, so a task keeps the counts of the words it has
seen, up to CACHE_BYTES and none of more than KEPT characters.  A long text is read in runs of about RUN
characters that end between words; of a long word the programme holds the last places that a piece can
reach back to.

Nulls: a null or empty text has 0 pieces.  Repeated rows are counted alike; extra columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship_code

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 192 << 20  # of the words and counts a task's process keeps, about; beyond it, it begins anew
KEPT = 64  # a word of more characters isn't kept
ENTRY_BYTES = 180  # of a kept word beside its characters
RUN = 1 << 20  # characters of a text that are cut into words at a time
_SHIFT = 40  # a count and the number of unknown characters share one number


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with log-probabilities by their rank (Zipf's rule).

    Piece k (from 0) gets log(1 / (k + 1)).  No score is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), -math.log(k + 1)) for k in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == pieces[unknown][0]))
        self.automaton.make_automaton()
        self.longest = max(map(len, scores), default=1)
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        named = {f"<0x{b:02X}>" for b in range(256)}
        self.bytes = byte_fallback and named <= scores.keys()

    def count(self, word: str) -> tuple[int, int]:
        """(pieces, characters no piece covers) of one word."""
        n = len(word)
        if not n:
            return 0, 0
        covered = self._covered(word) if n <= KEPT else None
        return self._any(word) if covered is None else (covered, 0)

    def _covered(self, word: str) -> int | None:
        """Pieces of a word each of whose characters is a piece; None for another word."""
        n = len(word)
        best: list = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0.0
        singles = 0
        for end, (length, value, unknown) in self.automaton.iter(word):
            end += 1
            before = best[end - length]
            if before is None or unknown:
                return None
            value += before
            now = best[end]
            if now is None or value > now:  # of one end the longest match comes first
                best[end] = value
                pieces[end] = pieces[end - length] + 1
            singles += length == 1
        return pieces[n] if singles == n else None

    def _any(self, word: str) -> tuple[int, int]:
        best, pieces, lost = [0.0], [0], [0]  # of the places from ``base`` on
        run = [False]  # the best way here ends in an unknown piece
        base = 0
        matches = self.automaton.iter(word)
        following = next(matches, None)
        for end in range(1, len(word) + 1):
            score, start, unknown, single = None, 0, False, False
            while following is not None and following[0] == end - 1:
                length, value, is_unknown = following[1]
                single |= length == 1
                candidate = value + best[end - length - base]
                if score is None or candidate > score:
                    score, start, unknown = candidate, end - length, is_unknown
                following = next(matches, None)
            if not single:
                candidate = self.unknown_score + best[end - 1 - base]
                if score is None or candidate > score:
                    score, start, unknown = candidate, end - 1, True
            before = start - base
            best.append(score)
            run.append(unknown)
            lost.append(lost[before] + (end - start) * unknown)
            if not unknown:
                pieces.append(pieces[before] + 1)
            elif self.bytes:
                pieces.append(pieces[before] + len(word[start:end].encode("utf-8", "replace")))
            else:
                pieces.append(pieces[before] + (not run[before]))
            if len(best) > 4096 + 2 * self.longest:
                gone = len(best) - self.longest - 1
                for places in (best, pieces, lost, run):
                    del places[:gone]
                base += gone
        return pieces[-1], lost[-1]


def runs_of(text: str, size: int = RUN) -> Iterator[list[str]]:
    """The words of the metaspace cut, without the U+2581 that begins each, a run of the text at a time."""
    at = int(text[:1] in (" ", SPACE))
    while at <= len(text) and text:
        end = len(text) if len(text) - at <= size else _cut(text, at + size)
        part = text[at:end]
        yield (part.replace(SPACE, " ") if SPACE in part else part).split(" ")
        at = end + 1


def _cut(text: str, at: int) -> int:
    found = [k for k in (text.find(" ", at), text.find(SPACE, at)) if k >= 0]
    return min(found, default=len(text))


def words_of(text: str) -> list[str]:
    """The words of the metaspace cut, each beginning with U+2581."""
    return [SPACE + w for words in runs_of(text) for w in words]


class Known:
    """Counts of the words that were seen, as one number each."""

    def __init__(self, counter: Counter, cache_bytes: int):
        self.counter, self.cache_bytes, self.room = counter, cache_bytes, cache_bytes
        self.kept: dict[str, int] = {}

    def total(self, text: str) -> tuple[int, int]:
        """(pieces, characters no piece covers) of a text."""
        total, kept = 0, self.kept
        for words in runs_of(text):
            long = []
            for word in set(words).difference(kept):
                pieces, lost = self.counter.count(SPACE + word)
                kept[word] = pieces + (lost << _SHIFT)
                if len(word) > KEPT:
                    long.append(word)
                else:
                    self.room -= ENTRY_BYTES + 2 * len(word)
            total += sum(map(kept.__getitem__, words))
            for word in long:
                del kept[word]
            if self.room < 0:  # frequent words soon come back
                kept.clear()
                self.room = self.cache_bytes
        return total & ((1 << _SHIFT) - 1), total >> _SHIFT


_known: dict[str, Known] = {}


def count_tokens(docs: DataFrame, path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, n_unknown (characters that no piece covers)."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known[path] = Known(Counter(vocabulary(path)), cache_bytes)
        for batch in batches:
            found = [_known[path].total(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                names=["doc_id", "n_tokens", "n_unknown"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_unknown long"
    )
