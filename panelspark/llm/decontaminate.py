"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ten consecutive words (an item of fewer words is one window).  A
window is the set of its five-word shingles (of its words as one shingle, if it has fewer than
five).  A text that contains the window contains all its shingles, so one of them is a necessary
prefix: the one with the fewest occurrences in the whole corpus.  Only occurrences of prefix shingles
leave the scan of the corpus, with the words around them that a window can take; a window that is one
shingle needs none.  They meet the windows in a join on the shingle, where a position bound (the window
must begin at or after the text's first word) and a length bound (it must end at or before the last) come
before the exact comparison of the words.

The corpus is scanned twice: to count the occurrences of the items' shingles, and to find the
prefixes.  Both scans test shingles against a bit table of fixed size, the only thing broadcast.  Beyond
some ten million shingles the table lets most words through; then the joins read more rows, and the result is
the same.  A text of any length is read in pieces, and its hits leave in slices.

Nulls: a null text or item has no words; an item without an id marks words but is not counted or
listed.  Repeated rows are separate documents; repeated items count once.  Empty tables give no rows
(documents) or no hits (benchmark).  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, text_buffers, text_key, without
from panelspark.llm.wordhash import LONG, Words, word_pieces

WINDOW = 10
SHINGLE = 5
FILTER_BITS = 26  # the bit table has 2**26 bits (8 MB), whatever the size of the benchmark

WINDOW_SCHEMA = "item_id long, words array<string>, n_words int, shingles array<long>"
FOUND_SCHEMA = (
    "row_id long, doc_id long, text_key long, n_words long,"
    " position long, shingle long, lead int, context array<string>"
)
ROWS = 4096  # windows or hits that leave a task at a time


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per window of an item: its words and the hashes of its shingles, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            ids = batch.column("item_id").to_pylist()
            for i, item_id in enumerate(ids):
                words = Words(raw, starts[i : i + 2])
                n = len(words.hash)
                if not n:
                    continue
                length = min(window, n)
                size = min(shingle, length)
                grams = words.grams(size)[0].view(np.int64)
                for begin in range(0, n - length + 1, ROWS):
                    stop = min(n - length + 1, begin + ROWS)
                    texts = [words.word(k) for k in range(begin, stop + length - 1)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array([item_id] * (stop - begin), pa.int64()),
                            "words": pa.array(
                                [texts[k : k + length] for k in range(stop - begin)], pa.list_(pa.string())
                            ),
                            "n_words": pa.array([length] * (stop - begin), pa.int32()),
                            "shingles": pa.array(
                                [grams[k : k + length - size + 1].tolist() for k in range(begin, stop)],
                                pa.list_(pa.int64()),
                            ),
                        }
                    )

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, WINDOW_SCHEMA)


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """A table of 2**FILTER_BITS bits with the bit of every hash set; at most 2**20 rows are read."""
    bit = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    rows = (
        hashes.select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _occurrences(docs: DataFrame, sizes: list[int], table, piece: int) -> DataFrame:
    """(shingle, n): occurrences in the texts, already summed within a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            seen = []
            for _, _, words, _, own, end in word_pieces(raw, starts, 0, max(sizes, default=1) - 1, piece):
                for size in sizes:
                    grams, at = words.grams(size)
                    grams = grams[(at >= own) & (at < end)]
                    seen.append(np.unique(grams[_listed(bits, grams)], return_counts=True))
            values = np.concatenate([v for v, _ in seen] or [np.zeros(0, np.uint64)])
            values, place = np.unique(values, return_inverse=True)
            counts = np.zeros(len(values), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, n in seen] or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(values.view(np.int64)), "n": pa.array(counts)})

    found = docs.select("text").mapInArrow(count, "shingle long, n long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n"))


def _prefix_hits(docs: DataFrame, sizes: list[int], table, shingle: int, reach: int, piece: int) -> DataFrame:
    """A row for each text, with its number of words, and one for each prefix shingle found in it.

    The latter has the shingle's place and the words around it, ``lead`` of them before it.
    """
    names = [part.split()[0] for part in FOUND_SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.int32(), pa.list_(pa.string())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value

        def out(columns: list) -> pa.RecordBatch:
            n = len(columns[0])
            arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def leave(hits: list[tuple]) -> pa.RecordBatch:
            row, position, gram, lead, context = map(list, zip(*hits, strict=True))
            return out([row, None, None, None, position, gram, lead, context])

        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            rows = batch.column("row_id").to_numpy()
            counts = np.zeros(len(rows), np.int64)
            hits: list[tuple] = []
            for i, j, words, offset, own, end in word_pieces(raw, starts, reach, reach + shingle - 1, piece):
                counts[i:j] += np.bincount(words.text[own:end], minlength=j - i)
                for size in sizes:
                    near = reach if size == shingle else 0  # a smaller shingle is a whole window
                    grams, at = words.grams(size)
                    hit = np.flatnonzero(_listed(bits, grams) & (at >= own) & (at < end))
                    for h, k in zip(grams[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                        text = int(words.text[k])
                        lo, hi = int(words.base[text]), int(words.base[text + 1])
                        a, b = max(lo, k - near), min(hi, k + near + size)
                        context = [words.word(x) for x in range(a, b)]
                        hits.append((int(rows[i + text]), k - lo + offset, h, k - a, context))
                        if len(hits) == ROWS:
                            yield leave(hits)
                            hits = []
            if hits:
                yield leave(hits)
            known = [batch.column(c) for c in ("row_id", "doc_id", "text_key")]
            yield out([*known, counts, None, None, None, None])

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long"),
        text_key(F.col("text")).alias("text_key"),
        "text",
    )
    return numbered.mapInArrow(find, FOUND_SCHEMA)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, piece: int = LONG
) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence of a window), the items found.

    Columns: doc_id, text_key, n_words, n_hit, n_items, items (their ids as text, sorted).  A text of more
    than ``piece`` bytes is read in pieces.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "decontaminate")
    shingle = min(shingle, window)
    items = steps.store(
        windows(benchmark, window, shingle).withColumn("window_id", F.monotonically_increasing_id()),
        "windows",
    )
    parts = items.select("window_id", F.posexplode("shingles").alias("offset", "shingle"))
    sizes = sorted(min(shingle, r[0]) for r in items.select("n_words").distinct().collect())
    sizes = sorted(set(sizes))  # at most `shingle` values

    table = spark.sparkContext.broadcast(bit_table(parts, "shingle"))
    counts = steps.store(_occurrences(docs, sizes, table, piece), "counts")
    prefixes = steps.store(
        parts.join(counts, "shingle", "left")
        .groupBy("window_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("window_id", "rarest.shingle", "rarest.offset"),
        "prefixes",
    )
    table = spark.sparkContext.broadcast(bit_table(prefixes, "shingle"))
    found = steps.store(_prefix_hits(docs, sizes, table, shingle, window - shingle, piece), "texts")
    texts = found.filter("position IS NULL")

    candidates = found.filter("position IS NOT NULL").select(
        "row_id", "position", F.col("shingle").alias("hit"), "lead", "context"
    )
    begin = F.col("position") - F.col("offset")
    first = F.col("lead") - F.col("offset")  # of the window's words in the context
    matched = (
        candidates.join(prefixes, F.col("hit") == F.col("shingle"))
        .filter((begin >= 0) & (first >= 0))
        .join(items.select("window_id", "item_id", "words", "n_words"), "window_id")
        .filter(first + F.col("n_words") <= F.size("context"))
        .filter(F.slice("context", (first + 1).cast("int"), F.col("n_words")) == F.col("words"))
        .select("row_id", "item_id", begin.alias("begin"), (begin + F.col("n_words")).alias("end"))
        .distinct()
    )
    before = Window.partitionBy("row_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("begin", F.coalesce("reached", "begin"))
    hits = (
        matched.withColumn("reached", F.max("end").over(before))
        .groupBy("row_id")
        .agg(
            F.sum(F.greatest(fresh, F.lit(0))).alias("n_hit"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    nothing = F.array().cast("array<string>")
    return texts.select("row_id", "doc_id", "text_key", "n_words").join(hits, "row_id", "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", nothing)).cast("long").alias("n_items"),
        F.coalesce("items", nothing).alias("items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold any window of an item; all columns stay."""
    found = decontaminate(docs, benchmark, **options).filter("n_hit > 0").select("doc_id", "text_key")
    return without(docs, Steps(docs.sparkSession, "contaminated").store(found.distinct(), "found"))
