"""Ranked lexical search: summed accumulators of short lists inside a skipping pass over long lists.

**Index.**  One scan of the texts keeps, for runs of documents (segments), the postings of the query
terms: for each term the documents that hold it, in order, and how often.  A segment is closed after
SEGMENT_DOCS documents or SEGMENT_POSTINGS postings (or one longer document), so its row is bounded.
Document frequencies and lengths are sums over the segments, so the texts are read once.

**Search.**  Each segment is searched for all queries inside one task.  A query's lists are short or
long within the segment.  The short ones are taken term at a time: their contributions are summed
into accumulators, which from then on are one iterator more, ordered by document and bounded by its
largest sum; the tenth largest sum is a first bound on the tenth score.  The iterators are then merged document at a time, in batches of documents in order:
iterators whose bounds together can't reach the current tenth score name no candidates, and are only
looked up for candidates that can still reach it, from the largest bound down.  Ties at the tenth
score are kept until the ids decide.  Each task returns its best documents of each query, which are
reduced in two steps.

The queries are taken in blocks of at most QUERY_TERMS different (query, term) pairs, so what a task
holds of them is bounded; each further block is one more pass over the index, not over the texts.

Terms are compared by a 64-bit hash.  Scores are 64-bit integers, and so are equal on every machine.
Nulls: a null text or query has no terms.  Each row of the queries is a query of its own, so a
repeated one returns its rows again; a query without terms, or whose terms occur nowhere, returns
none.  Each row of the documents is a document of its own; equal scores come by ascending doc_id, null
ids last.  Texts of any length are read in pieces of 512 KB, or one longer text.  Extra columns are
not read.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, byte_slices, text_buffers
from panelspark.llm.wordhash import Words

TOP = 10
SEGMENT_DOCS = 1 << 15
SEGMENT_POSTINGS = 1 << 21
QUERY_TERMS = 1 << 20
SHORT = 64  # a list of at most one in so many of the segment's documents is short
BATCH = 1024  # candidate documents scored at a time
FILTER_BITS = 26  # the terms' bit table has 2**26 bits (8 MB), whatever the number of queries
PARTS = 64  # of the first step that reduces a query's rows

INDEX = (
    "docs array<long>, lengths array<long>, terms array<long>, starts array<int>, at array<int>, uses array<int>"
)
FOUND = "query long, doc_id long, score long"


def query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, term): the different terms of each row of the queries, as hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            for i, j in byte_slices(starts):
                words = Words(raw, starts[i : j + 1])
                pair = np.unique(np.stack([words.text.astype(np.uint64), words.hash]), axis=1)
                at = pa.array(pair[0].astype(np.int64) + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("id").take(at), pa.array(pair[1].view(np.int64))],
                    names=["row", "id", "term"],
                )

    numbered = queries.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
    )
    return numbered.mapInArrow(cut, "row long, id long, term long")


def _bit_table(terms: DataFrame) -> np.ndarray:
    """A table of 2**FILTER_BITS bits with the bit of every term set; at most 2**20 rows are read."""
    bit = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    rows = (
        terms.select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


class _Segment:
    """Postings of a run of documents, gathered text by text and closed into one row."""

    def __init__(self):
        self.docs, self.lengths, self.hashes, self.owners, self.uses = [], [], [], [], []
        self.n, self.postings = 0, 0

    def add(self, ids, lengths, hashes, owners, uses) -> None:
        self.docs.append(ids)
        self.lengths.append(lengths)
        self.hashes.append(hashes)
        self.owners.append(owners + self.n)
        self.uses.append(uses)
        self.n += len(lengths)
        self.postings += len(hashes)

    def row(self) -> pa.RecordBatch:
        hashes, owners, uses = (np.concatenate(x) for x in (self.hashes, self.owners, self.uses))
        order = np.lexsort((owners, hashes))
        hashes, owners, uses = hashes[order], owners[order], uses[order]
        terms, starts = np.unique(hashes, return_index=True)
        starts = np.append(starts, len(hashes))

        def cell(values, kind):
            return pa.array([values], pa.list_(kind))

        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), pa.concat_arrays(self.docs)),
                cell(np.concatenate(self.lengths).astype(np.int64), pa.int64()),
                cell(terms.view(np.int64), pa.int64()),
                cell(starts.astype(np.int32), pa.int32()),
                cell(owners.astype(np.int32), pa.int32()),
                cell(uses.astype(np.int32), pa.int32()),
            ],
            names=["docs", "lengths", "terms", "starts", "at", "uses"],
        )


def build_index(docs: DataFrame, bits, segment_docs: int, segment_postings: int) -> DataFrame:
    """One row per segment: ids and lengths of its documents, and the postings of its terms."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segment = bits.value, _Segment()
        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            for i, j in byte_slices(starts):
                words = Words(raw, starts[i : j + 1])
                bit = words.hash >> np.uint64(64 - FILTER_BITS)
                listed = (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                hit = np.flatnonzero(listed)
                hashes, owners = words.hash[hit], words.text[hit]
                order = np.lexsort((hashes, owners))
                hashes, owners = hashes[order], owners[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
                first = np.flatnonzero(new)
                uses = np.diff(np.append(first, len(hashes)))
                segment.add(batch.column("doc_id").slice(i, j - i), words.count, hashes[first], owners[first], uses)
                if segment.n >= segment_docs or segment.postings >= segment_postings:
                    yield segment.row()
                    segment = _Segment()
        if segment.n:
            yield segment.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX)


class _Best:
    """The best documents of one query so far: highest score first, then the smallest id."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[keep], ids[keep]


def _look_up(docs: np.ndarray, gains: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The list's gains at the wanted documents, 0 where it doesn't hold one."""
    place = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[place] == wanted, gains[place], 0)


def _sum_lists(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the lists' gains summed by document."""
    docs = np.concatenate([d for d, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[first], np.add.reduceat(np.concatenate([g for _, g in lists])[order], first)


def search_segment(lists: list[tuple[np.ndarray, np.ndarray]], short: int, ids: np.ndarray, best: _Best) -> None:
    """Offers ``best`` the documents of one segment; a list holds documents in order and their gains."""
    few = [x for x in lists if len(x[0]) <= short]
    iterators = [x for x in lists if len(x[0]) > short]
    floor = 1
    if few:
        docs, sums = _sum_lists(few)
        iterators.append((docs, sums))
        if len(sums) >= best.top:  # so many documents have these scores at least
            floor = max(1, int(np.partition(sums, -best.top)[-best.top]))
    bounded = sorted(((int(g.max()), d, g) for d, g in iterators if len(d)), key=lambda x: x[0])
    bounded = [x for x in bounded if x[0] > 0]
    if not bounded:
        return
    reach = np.cumsum([bound for bound, _, _ in bounded])  # of an iterator and all smaller ones
    begin = 0  # documents before it are done
    end = max(int(d[-1]) for _, d, _ in bounded) + 1
    while begin < end:
        least = max(floor, best.least)
        named = int(np.searchsorted(reach, least, side="left"))  # from here on they name candidates
        if named == len(bounded):
            return
        # the next documents that the naming iterators hold, up to where all of them were read
        upto, parts = end, []
        for _, docs, _ in bounded[named:]:
            at = int(np.searchsorted(docs, begin))
            part = docs[at : at + BATCH]
            if at + BATCH < len(docs):
                upto = min(upto, int(part[-1]) + 1)
            parts.append(part)
        wanted = np.unique(np.concatenate(parts))
        wanted = wanted[: np.searchsorted(wanted, upto)]
        begin = upto
        scores = np.zeros(len(wanted), np.int64)
        for k in range(len(bounded) - 1, -1, -1):
            if k < named:
                able = scores + reach[k] >= least
                wanted, scores = wanted[able], scores[able]
            if not len(wanted):
                break
            scores += _look_up(bounded[k][1], bounded[k][2], wanted)
        good = scores >= least
        if good.any():
            best.offer(scores[good], ids[wanted[good]])


def _search(index: DataFrame, block, top: int, short: int) -> DataFrame:
    """(query, doc_id, score): the best documents that each task found for each query of the block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, first, terms, weights, known, n_docs, total = block.value
        best = [_Best(top) for _ in queries]
        for batch in batches:
            for k in range(batch.num_rows):
                cells = [batch.column(c)[k].values for c in ("lengths", "terms", "starts", "at", "uses")]
                lengths, own, starts, at, uses = (c.to_numpy(zero_copy_only=False) for c in cells)
                raw_ids = batch.column("docs")[k].values
                ids = raw_ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                if not len(own):
                    continue
                own = own.view(np.uint64)
                # the weight of each list of the segment, and the gain of each posting
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                wanted = known[place] == own
                weight = np.repeat(np.where(wanted, weights[place], 0), np.diff(starts))
                uses = uses.astype(np.int64)
                m = 100 - 90 + _length_terms(lengths, n_docs, total)
                gains = weight * ((1_000_000_000 * uses) // (1000 * uses + 8 * m[at]))
                begin = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                held = own[begin] == terms
                most = max(1, len(lengths) // short)
                for q in range(len(queries)):
                    mine = begin[first[q] : first[q + 1]][held[first[q] : first[q + 1]]]
                    if len(mine):
                        lists = [(at[starts[t] : starts[t + 1]], gains[starts[t] : starts[t + 1]]) for t in mine]
                        search_segment(lists, most, ids, best[q])
        size = [len(b.ids) for b in best]
        if sum(size):
            ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries, size)),
                    pa.array(ids, mask=ids == np.iinfo(np.int64).max),
                    pa.array(np.concatenate([b.scores for b in best])),
                ],
                names=["query", "doc_id", "score"],
            )

    return index.mapInArrow(find, FOUND)


def _length_terms(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a document's length adds to its m: (90 * n * N) div L."""
    if not len(lengths) or 90 * int(lengths.max()) * n_docs < 1 << 63:
        return (90 * lengths * n_docs) // max(total, 1)
    exact = [90 * n * n_docs // max(total, 1) for n in lengths.tolist()]  # beyond 64 bits on the way
    return np.array(exact, np.int64)


def search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    id_column: str = "item_id",
    text_column: str = "text",
    short: int = SHORT,
    segment_docs: int = SEGMENT_DOCS,
    segment_postings: int = SEGMENT_POSTINGS,
    query_terms_of_block: int = QUERY_TERMS,
) -> DataFrame:
    """(query_row, query_id, rank, doc_id, score): the ``top`` documents of each row of the queries."""
    spark = docs.sparkSession
    steps = Steps(spark, "search")
    asked = steps.store(query_terms(queries, id_column, text_column), "asked")
    bits = spark.sparkContext.broadcast(_bit_table(asked))
    index = steps.store(build_index(docs, bits, segment_docs, segment_postings), "index")

    counted = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)
    worded = F.size(F.filter("lengths", lambda n: n > 0)).cast("long")
    n_docs, total = index.agg(F.sum(worded), F.sum(counted)).first()
    n_docs, total = n_docs or 0, total or 0
    lists = index.select(F.posexplode("terms").alias("k", "term"), "starts").select(
        "term", (F.element_at("starts", F.col("k") + 2) - F.element_at("starts", F.col("k") + 1)).alias("df")
    )
    found_in = lists.groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    weighed = steps.store(
        asked.join(found_in, "term").select("row", "term", F.floor(1000 * F.log(ratio)).alias("weight")), "weighed"
    )

    n_blocks = max(1, math.ceil(weighed.count() / query_terms_of_block))
    parts = []
    for number in range(n_blocks):
        own = weighed.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == number).toPandas()
        own = own.sort_values(["row", "term"])
        rows, first = np.unique(own["row"].to_numpy(np.int64), return_index=True)
        terms = own["term"].to_numpy(np.int64).view(np.uint64)
        known, at = np.unique(terms, return_index=True)
        if not len(rows):
            continue
        weights = own["weight"].to_numpy(np.int64)[at]
        block = (rows, np.append(first, len(terms)), terms, weights, known, n_docs, total)
        parts.append(_search(index, spark.sparkContext.broadcast(block), top, short))
    if not parts:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)).alias("part")
    near = Window.partitionBy("query", "part").orderBy(*order)
    ranked = Window.partitionBy("query").orderBy(*order)
    best = (
        found.select("*", part)
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
    )
    names = asked.groupBy(F.col("row").alias("query")).agg(F.min("id").alias("query_id"))
    return best.join(names, "query").select(
        F.col("query").alias("query_row"), "query_id", "rank", "doc_id", "score"
    )
