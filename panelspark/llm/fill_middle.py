"""Fill-in-middle transformation, its cuts found word by word in the UTF-8 bytes.

A text's units are its runs of letters A-Z, a-z and each other character.  The bytes of a batch of
texts are viewed as 64-bit words, eight bytes at a time.  Arithmetic on whole words marks the bytes
that end a unit: a byte ends a character unless a continuation byte follows, and a letter followed by
a letter ends no unit.  `bitwise_count` counts the marks of each word, their running sum is searched
for the word that holds a unit's end, and the mark within that word is selected by halving it.  No
text is decoded and no unit becomes an object.

The cuts come from the sha256 of the document's id, so a document is always cut alike, wherever its
row lies.  The texts' parts are put together by Spark's own string functions, and `restore` takes the
text out of them again.

Nulls: a null text is an empty one, which stays plain; a null id is hashed as no digits.  Repeated
rows are cut alike.  A text that holds a sentinel itself stays plain, so that every output can be
restored.  Texts of any length are handled whole: a batch's words and marks take about ten times the
bytes of a slice of 512 KB of texts, or of one longer text.  Empty tables give no rows.  Extra columns
stay; a column named ``fim`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import byte_slices, ship_code, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_SHARE = 90  # of a hundred documents, so many are not plain
SPM_SHARE = 20  # of a hundred that are not plain, so many begin with the suffix

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x20) * _ONES
_FROM_A = np.uint64(0x80 - 0x61) * _ONES  # carries into the high bit from 'a' on
_PAST_Z = np.uint64(0x80 - 0x7B) * _ONES  # carries into the high bit past 'z'
_ONE, _SEVEN, _EIGHT = np.uint64(1), np.uint64(7), np.uint64(8)

_CUTS = "struct<n:long,prefix_chars:long,middle_chars:long>"


def _following(marks: np.ndarray) -> np.ndarray:
    """The marks of the following byte, at each byte."""
    out = marks >> _EIGHT
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Units:
    """Ends of units and of characters in a run of texts, as marks in 64-bit words."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        begin, stop = int(starts[0]), int(starts[-1])
        self.offsets = (starts - begin).astype(np.int64)
        size = stop - begin
        padded = np.zeros((size // 8 + 1) * 8, np.uint8)
        padded[:size] = raw[begin:stop]
        x = padded.view("<u8")

        folded = (x | _CASE) & _LOW7
        letter = (folded + _FROM_A) & ~(folded + _PAST_Z) & ~x & _HIGH
        continued = x & ~(x << _ONE) & _HIGH  # bytes 10xxxxxx
        chars = ~_following(continued) & _HIGH
        units = chars & ~(letter & _following(letter))
        self.chars, self.units = self._closed(chars, size), self._closed(units, size)
        self.chars_before, self.units_before = self._sums(self.chars), self._sums(self.units)

    def _closed(self, marks: np.ndarray, size: int) -> np.ndarray:
        """The marks, with one at the last byte of each text and none behind the last text."""
        marks = np.ascontiguousarray(marks, "<u8")
        flat = marks.view(np.uint8)
        full = self.offsets[1:] > self.offsets[:-1]
        flat[self.offsets[1:][full] - 1] = 0x80
        flat[size:] = 0
        return marks

    @staticmethod
    def _sums(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=sums[1:])
        return sums

    @staticmethod
    def _before(marks: np.ndarray, sums: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        below = (_ONE << (byte * _EIGHT)) - _ONE  # the bytes of the word before the place
        return sums[word] + np.bitwise_count(marks[word] & below)

    def n_units(self) -> np.ndarray:
        return np.diff(self._before(self.units, self.units_before, self.offsets))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The place after the first ``k`` units of each text (``k`` of them at most as it has)."""
        first = self._before(self.units, self.units_before, self.offsets[:-1])
        rank = first + k  # the rank of the unit's end among all marks
        word = np.clip(np.searchsorted(self.units_before, rank, side="left") - 1, 0, len(self.units) - 1)
        left = (rank - self.units_before[word]).astype(np.uint64)
        rest, at = self.units[word] >> _SEVEN, np.zeros(len(word), np.int64)
        for width in (32, 16, 8):
            half = rest & np.uint64((1 << width) - 1)
            n = np.bitwise_count(half).astype(np.uint64)
            above = left > n
            left = np.where(above, left - n, left)
            rest = np.where(above, rest >> np.uint64(width), half)
            at += np.where(above, width // 8, 0)
        return np.where(k > 0, word * 8 + at + 1, self.offsets[:-1])

    def n_chars(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Characters in the bytes from ``begin`` to ``end``, both ends of characters."""
        return self._before(self.chars, self.chars_before, end) - self._before(
            self.chars, self.chars_before, begin
        )


def find_cuts(raw: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Units of each text, and the characters before the first cut and between the cuts."""
    out = []
    for i, j in byte_slices(starts):
        units = Units(raw, starts[i : j + 1])
        n = units.n_units()
        a, b = h1[i:j] % (n + 1), h2[i:j] % (n + 1)
        first, second = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
        out.append(np.stack([n, units.n_chars(units.offsets[:-1], first), units.n_chars(first, second)]))
    return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, np.int64)] * 3


def _cuts(spark) -> Column:
    ship_code(spark)

    @F.pandas_udf(_CUTS)
    def cuts(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, h1, h2 in frames:
            raw, starts = text_buffers(pa.array(text, pa.string()))
            n, prefix, middle = find_cuts(raw, starts, h1.to_numpy(np.int64), h2.to_numpy(np.int64))
            yield pd.DataFrame({"n": n, "prefix_chars": prefix, "middle_chars": middle})

    return cuts


def _digits(doc_id: Column, k: int) -> Column:
    """The k-th group of eight digits of the sha256 of the id, as a number."""
    text = F.concat(F.lit("1:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fim``: n (units), form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    cuts = _cuts(docs.sparkSession)(text, _digits(doc_id, 1), _digits(doc_id, 2))
    plain = text == ""
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain |= text.contains(sentinel)
    plain |= F.pmod(_digits(doc_id, 3), F.lit(100)) >= FIM_SHARE
    form = (
        F.when(plain, "plain")
        .when(F.pmod(_digits(doc_id, 4), F.lit(100)) < SPM_SHARE, "spm")
        .otherwise("psm")
    )
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "fim"]
    cut = docs.select(*columns, F.struct(cuts.alias("cuts"), form.alias("form")).alias("fim"))
    start, length = F.col("fim.cuts.prefix_chars"), F.col("fim.cuts.middle_chars")
    prefix = F.substring(text, F.lit(1), start.cast("int"))
    middle = F.substring(text, (start + 1).cast("int"), length.cast("int"))
    suffix = F.substring(text, (start + length + 1).cast("int"), F.char_length(text))
    output = (
        F.when(F.col("fim.form") == "plain", text)
        .when(
            F.col("fim.form") == "psm",
            F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle),
        )
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    uncut = F.col("fim.form") == "plain"
    return cut.select(
        *columns,
        F.struct(
            F.col("fim.cuts.n").alias("n"),
            F.col("fim.form").alias("form"),
            F.when(~uncut, start).alias("prefix_chars"),
            F.when(~uncut, length).alias("middle_chars"),
            output.alias("output"),
        ).alias("fim"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of that form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
