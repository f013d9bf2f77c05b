"""Best-fit packing of token pieces under several capacities.

Texts are tokenised, an end id is appended, and what is longer than a sequence is cut into pieces of a
full sequence and a rest.  A sequence has three capacities: tokens, documents, and attention cost (the sum of
the squared lengths).  Pieces are placed in falling order of length.  Of the sequences that have room
in every dimension the best is chosen by the weighted squared norm of what would be left (``norm``)
or by the weighted dot product of the piece and what is left (``dot``); if none has room, a new one is
opened.

Pieces are dealt by hash into buckets of bounded size, one packed at a time in a task.  Sequences that
stay less full than FULL are opened again, and their pieces are packed anew in the next round, in fewer
buckets, so that the poorly filled ends of all buckets meet.  Only lengths are shuffled.

Tokenising: texts of common Latin characters are cut at white space, and the ids of each distinct unit
come from the tokenizer's own model once per task's process (up to CACHE_BYTES are kept, and none of more
than KEPT characters); any other text goes through the whole tokenizer, unit by unit between spaces and
line ends.  A long text is read in runs of about RUN characters that end between units.

Nulls: a null text is an empty one: its only token is the end id.  Repeated rows are packed each.  An
empty table gives no rows.  Extra columns are not read.  Ties: equal lengths by row and piece number,
equal sequences by the one opened first.
"""

from __future__ import annotations

import json
import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Steps

TOKENS = 4096
END_ID = 1
BUCKET = 4000
FULL = 0.97
ROUNDS = 6
CACHE_BYTES = 256 << 20  # of the units and ids a task's process keeps, about; beyond it, it begins anew
KEPT = 64  # a unit of more characters isn't kept
ENTRY_BYTES = 220  # of a kept unit beside its characters and ids
RUN = 1 << 20  # characters of a text that are cut into units at a time
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]")
_BREAK = re.compile("[ \\n]+")
_SPACE = re.compile("\\s+")


class Ids:
    """Token ids of texts as little-endian 32-bit values, equal to the tokenizer's."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.parts = regex.compile(steps[0]["pattern"]["Regex"])
        self.cache_bytes = self.room = cache_bytes
        self.plain: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in printable}
        for b in range(256):
            if b not in self.byte_chars:
                self.byte_chars[b] = chr(256 + len(self.byte_chars) - len(printable))

    def _plain(self, unit: str) -> bytes:
        ids = array("I")
        for part in (unit,) if unit.isalpha() else self.parts.findall(unit):  # letters alone are one part
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_chars)
            ids.extend([token.id for token in self.model.tokenize(spelled)])
        return _little(ids)

    def _other(self, unit: str) -> bytes:
        return _little(array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids))

    def of(self, text: str, run: int = RUN) -> bytes:
        special = _OTHER.search(text) is not None or "<|" in text
        if len(text) <= run:
            return self._run(text, special)
        out, at = [], 0
        while at < len(text):
            gap = _BREAK.search(text, at + run) if special else _SPACE.search(text, at + run)
            end = gap.start() if gap else len(text)
            out.append(self._run(text[at:end], special))
            at = gap.end() if gap else end
        return b"".join(out)

    def _run(self, text: str, special: bool) -> bytes:
        if special:
            units, known, make = _BREAK.split(text), self.other, self._other
        else:
            units, known, make = text.lower().split(), self.plain, self._plain
        long = []
        for unit in set(units).difference(known):
            known[unit] = value = make(unit)
            if len(unit) > KEPT:
                long.append(unit)
            else:
                self.room -= ENTRY_BYTES + 2 * len(unit) + len(value)
        out = b"".join(map(known.__getitem__, units))
        for unit in long:
            del known[unit]
        if self.room < 0:  # frequent units soon come back
            self.plain.clear()
            self.other.clear()
            self.room = self.cache_bytes
        return out


def _little(ids: array) -> bytes:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


_ids: dict[str, Ids] = {}


def tokenise(
    docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of each text: row_id, doc_id, piece, start, length, ids_crc32 (and ``ids``, if asked)."""
    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ids:
            _ids[path] = Ids(path)
        source = _ids[path]
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            rows, ids = batch["row_id"].to_pylist(), batch["doc_id"].to_pylist()
            for row, doc, text in zip(rows, ids, batch["text"], strict=True):
                data = source.of(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * tokens)):
                    part = data[at : at + 4 * tokens]
                    made = (row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*made, part) if with_ids else made)
            columns = list(zip(*out, strict=True)) if out else [[]] * (6 + with_ids)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=False)],
                names=[part.split()[0] for part in schema.split(", ")],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text"
    )
    return numbered.mapInArrow(cut, schema)


def best_fit(
    lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, given in falling order of length.

    ``capacity`` and ``weights``: tokens, documents, attention cost.
    """
    n = len(lengths)
    left = np.zeros((n, 3))
    used = np.zeros(n, np.int64)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened = 0
    first = 0  # sequences before this one have no room for any piece to come
    least = lengths.min() if n else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], float)
        after = left[first:opened] - need
        fits = np.flatnonzero((after >= 0).all(axis=1))
        if len(fits):
            if rule == "norm":
                rest = after[fits] / capacity
                best = fits[np.argmin((weights * rest * rest).sum(axis=1))]
            else:
                have = left[first:opened][fits] / capacity
                best = fits[np.argmax((weights * (need / capacity) * have).sum(axis=1))]
            s = int(best) + first
        else:
            s = opened
            if (need > capacity).any():
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            left[s] = capacity
            opened += 1
        left[s] -= need
        sequence[i], offset[i] = s, used[s]
        used[s] += length
        while first < opened and left[first, 0] < least:
            first += 1
    return sequence, offset


def pack(
    pieces: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    bucket: int = BUCKET,
    full: float = FULL,
) -> DataFrame:
    """(row_id, piece, sequence_id, offset) for pieces (row_id, piece, length).

    ``documents`` and ``attention`` cap the pieces and the attention cost of a sequence; None leaves
    them at what the token capacity implies (tokens, tokens squared).
    """
    steps = Steps(pieces.sparkSession, "pack")
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    weight = np.array(weights, float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "piece"], ascending=[False, True, True])
        sequence, offset = best_fit(pdf["length"].to_numpy(), capacity, weight, rule)
        held = np.bincount(sequence, pdf["length"])
        return pd.DataFrame(
            {
                "row_id": pdf["row_id"].to_numpy(),
                "piece": pdf["piece"].to_numpy(),
                "length": pdf["length"].to_numpy(),
                "bucket": pdf["bucket"].to_numpy(),
                "sequence": sequence,
                "offset": offset,
                "filled": held[sequence] / tokens,
            }
        )

    schema = "row_id long, piece int, length long, bucket long, sequence long, offset long, filled double"
    todo, done = pieces.select("row_id", "piece", "length"), []
    for k in range(ROUNDS):
        n = todo.count()
        buckets = max(1, math.ceil(n / bucket))
        dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(buckets)))
        packed = steps.store(dealt.groupBy("bucket").applyInPandas(one, schema), f"round-{k}")
        last = buckets == 1 or k == ROUNDS - 1
        kept = packed if last else packed.filter(F.col("filled") >= full)
        number = F.lit(k * 10**16) + F.col("bucket") * 10**6 + F.col("sequence")
        done.append(kept.select("row_id", "piece", number.alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.filter(F.col("filled") < full).select("row_id", "piece", "length")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per sequence: its ids (binary, 32-bit little-endian) and its pieces in order.

    ``pieces`` must hold ``ids``.  A sequence has at most its capacity of tokens, so a group is bounded.
    """
    joined = pieces.join(placed, ["row_id", "piece"])
    entry = F.struct("offset", "doc_id", "piece", "length", "ids")
    return (
        joined.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select(
            "sequence_id",
            F.aggregate("e", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
            F.transform("e", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"),
        )
    )


def pack_documents(docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID, **caps) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    steps = Steps(docs.sparkSession, "tokens")
    pieces = steps.store(tokenise(docs, path, tokens, end_id), "pieces")
    placed = pack(pieces, tokens, **caps)
    return pieces.join(placed, ["row_id", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
