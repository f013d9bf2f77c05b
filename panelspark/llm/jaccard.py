"""N-gram Jaccard join by MinHash banding.

Each text becomes the set of its five-word shingles (a text of fewer words is one shingle).  Texts with
equal sets form one class and are represented by one row from then on, so a group of copies of any
size costs one row.  The representative's MinHash signature is cut into bands; rows and bands are
chosen so that a pair at the threshold shares a band with at least the target recall.

Representatives are shuffled on band hashes.  Bands that gather the same members are kept once.  Each
remaining gathering is verified inside a task on the full shingle sets: the Jaccard value of every
pair of it comes from one matrix product, and nothing is emitted per pair.  A pair is counted only in
the first band it shares, so no link is counted twice.  What leaves the task is linear: the number
of links of each member and the edges of a spanning forest, from which large-star/small-star rounds
make the classes.  A gathering of more than BLOCK members or BLOCK_BYTES of text is compared block against
block, in separate tasks.

Nulls: a null text is an empty one; texts without words form one class (their sets are equal).
Rows are told apart by a stored number, so repeated ids and repeated rows are each one document.
Empty tables give no rows.  Ties: the smallest doc_id names a class (null if no member has an id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, among, byte_slices, free_names, slot, text_buffers, text_key, without
from panelspark.llm.wordhash import STEP, mix, word_pieces

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.998
MAX_HASHES = 160
BLOCK = 2048  # members of a gathering verified against each other in one task
LEAST_TASKS = 8  # of a step of the component rounds
SLICE = 128  # members whose pairs with all others are judged at a time
SALTS = 16  # parts that the rows of a class are split into when they meet its name
BLOCK_BYTES = 1 << 24  # bytes of text of a block, about; a longer text is a block of its own
BIN_ROWS = 3000  # members of small gatherings that share a task's group
BIN_BYTES = 1 << 24  # bytes of text of small gatherings that share a task's group, about
HOT = 1000  # a node with more than one in so many of the edges meets its least neighbour by a broadcast


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows per band for which a pair at the threshold meets with this recall.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands.
    """
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        met = threshold**rows
        bands = 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def gram_sets(raw: np.ndarray, starts: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a run of texts, with the text of each; a text of fewer words is one shingle.

    The words of a long text are held a piece at a time; what grows with it is its set.
    """
    parts, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    before, cut = -1, False
    for i, _, words, offset, own, end in word_pieces(raw, starts, after=ngram - 1):
        grams, at = words.grams(ngram)
        mine = (at >= own) & (at < end)
        found = [(grams[mine], words.text[at[mine]])]
        if offset + own == 0 and end > own:  # the piece with the first word shows whether there are enough
            for size in range(1, ngram):
                if (words.count == size).any():
                    short, first = words.grams(size)
                    fits = words.count[words.text[first]] == size
                    found.append((short[fits], words.text[first[fits]]))
        grams, owner = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        parts.append(grams)
        owners.append(owner + i)
        cut |= i == before
        before = i
    grams, owner = np.concatenate(parts), np.concatenate(owners)
    return _distinct(grams, owner) if cut else (grams, owner)


def signatures(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """One row per document: row_id, doc_id, a key of its text, two keys of its set, band hashes."""
    schema = (
        "row_id long, doc_id long, text_key long, set_a long, set_b long, n_grams long, size long, bands array<long>"
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(bands * rows)
        for batch in batches:
            raw, starts = text_buffers(batch.column("text"))
            keys_a, keys_b, sizes, hashed = [], [], [], []
            for i, j in byte_slices(starts):
                grams, owner = gram_sets(raw, starts[i : j + 1], ngram)
                n = np.bincount(owner, minlength=j - i)
                full = np.flatnonzero(n)
                value = np.zeros((j - i, bands), np.uint64)
                a, b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(full):
                    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    a[full] = np.add.reduceat(grams, begin)
                    b[full] = np.add.reduceat(mix(grams ^ np.uint64(STEP)), begin)
                    for band in range(bands):
                        v = np.full(len(full), band, np.uint64)
                        for m in multipliers[band * rows : (band + 1) * rows]:
                            v = mix(v * np.uint64(STEP) + np.minimum.reduceat(grams * m, begin))
                        value[full, band] = v
                keys_a.append(a)
                keys_b.append(b)
                sizes.append(n)
                hashed.append(value)
            if not sizes:
                continue
            flat = np.concatenate(hashed).view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(flat) + 1, dtype=np.int32) * bands), pa.array(flat.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(np.concatenate(keys_a).view(np.int64)),
                    pa.array(np.concatenate(keys_b).view(np.int64)),
                    pa.array(np.concatenate(sizes).astype(np.int64)),
                    pa.array(np.diff(starts)),
                    lists,
                ],
                names=["row_id", "doc_id", "text_key", "set_a", "set_b", "n_grams", "size", "bands"],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long"),
        text_key(F.col("text")).alias("text_key"),
        "text",
    )
    return numbered.mapInArrow(sign, schema)


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the rows that the pairs connect one label, the smallest row of theirs."""
    while len(a):
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        differ = low < high
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(label, high, low)
        while True:
            following = label[label]
            if (following == label).all():
                break
            label[:] = following


def _shared(grams: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """The number of shingles that each two of ``m`` texts have in common."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(first) - 1
    common = np.bincount(column, minlength=1)[column] > 1 if len(grams) else first
    owner, column = owner[common], column[common]
    shared = np.zeros((m, m), np.float32)
    step = max(1, (1 << 23) // max(m, 1))  # shingles whose holders are in one matrix
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + step))
        _, place = np.unique(column[at:end], return_inverse=True)
        dense = np.zeros((m, int(place.max()) + 1), np.float32)
        dense[owner[at:end], place] = 1
        for k in range(0, m, SLICE):
            shared[k : k + SLICE] += dense[k : k + SLICE] @ dense.T
        at = end
    return shared


def _verify(pdf: pd.DataFrame, ngram: int, threshold: float) -> pd.DataFrame:
    """Links of the gatherings of one group: per member a count, per new connection an edge.

    Beside the texts and their sets, a gathering of m members holds one matrix of m x m numbers; all
    that is derived from it is held for SLICE members at a time.
    """
    node, count, root = [], [], []
    for _, own in pdf.groupby(["band", "hash", "block_a", "block_b"], sort=False):
        own = own.drop_duplicates("node")
        nodes, weight = own["node"].to_numpy(np.int64), own["copies"].to_numpy(np.int64)
        band, across = int(own["band"].iloc[0]), own["block_a"].iloc[0] != own["block_b"].iloc[0]
        bands = np.ascontiguousarray(np.stack(own["bands"].to_numpy())[:, :band].T)
        side = own["block"].to_numpy() == own["block_a"].iloc[0]
        raw, starts = text_buffers(pa.array(own["text"], pa.string()))
        grams, owner = gram_sets(raw, starts, ngram)
        m = len(own)
        size = np.bincount(owner, minlength=m)
        shared = _shared(grams, owner, m)
        links, label = np.zeros(m, np.int64), np.arange(m)
        wide = size.astype(np.float32)
        for k in range(0, m, SLICE):
            part = shared[k : k + SLICE]
            # wide enough for the rounding of single precision; then exact in integers
            linked = part >= np.float32(threshold) * (wide[k : k + SLICE, None] + wide - part) - 0.5
            if across:
                linked &= side[k : k + SLICE, None] != side
            for earlier in bands:  # a pair counts in the first band it shares
                linked &= earlier[k : k + SLICE, None] != earlier
            a, b = np.nonzero(linked)
            s = part[a, b].astype(np.int64)
            a += k
            keep = (a != b) & (s * 1_000_000 >= round(threshold * 1_000_000) * (size[a] + size[b] - s))
            a, b = a[keep], b[keep]
            links += np.bincount(a, weight[b], minlength=m).astype(np.int64)
            connect(label, a, b)
        found = np.flatnonzero(links)
        node.append(nodes[found])
        count.append(links[found])
        root.append(nodes[label[found]])
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"node": np.concatenate(node or none), "links": np.concatenate(count or none), "root": np.concatenate(root or none)})


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with the least neighbour ``m`` of u; ``least`` has u, m and the degree of u.

    The edges of a hot node stay where they are: fewer than 2 * HOT nodes can hold more than one in
    HOT of ``total`` edges, so their rows are broadcast.  Only the others' edges are dealt by node.
    """
    most = max(1, total // HOT)
    hot = least.filter(F.col("degree") > most)
    others = least.filter(F.col("degree") <= most).select("u", "m")
    near = edges.join(F.broadcast(hot.select("u", "m")), "u")
    rest = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(others, "u")
    return near.unionByName(rest)


def components(
    steps: Steps, edges: DataFrame, name: str = "star", rounds: int = 40, per_task: int | None = None
) -> DataFrame:
    """(node, root): the smallest node of each node's component, by large-star and small-star rounds.

    Each round is a grouping and a join on the narrow edge table, written to the shared folder.  The
    number of rounds grows with the logarithm of the longest chain.  The groupings combine before the
    shuffle, and the joins leave the edges of hot nodes in place, so no task holds one node's edges.  With
    ``per_task`` a step runs in as many tasks as its edges need at so many each, and not in more.
    """

    def fewer(df: DataFrame) -> DataFrame:
        return df if per_task is None or total is None else df.coalesce(max(LEAST_TASKS, 2 * total // per_task))

    total = None
    pair = edges.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v"))
    current = steps.store(pair.filter("u <> v").distinct(), f"{name}-0")
    total = current.count()
    state = None
    for k in range(1, rounds + 1):
        both = current.union(current.select("v", "u"))
        least = fewer(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        least = least.withColumn("m", F.least("u", "m"))
        large = _with_least(both, least, total).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fewer(large.filter("u <> v").distinct())
        low = fewer(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        small = (
            _with_least(large, low, total)
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
        )
        following = steps.store(fewer(small.filter("u <> v").distinct()), f"{name}-{k}")
        found = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        steps.drop(f"{name}-{k - 1}")
        current = following
        if found == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, total = found, found[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _place(members: DataFrame, block: int, block_bytes: int, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """``members`` of gatherings with the blocks and the bin, one task's group, in which each is compared."""
    total, size = members.agg(F.count("*"), F.sum("size")).first()
    n_bins = max(1, math.ceil(total / BIN_ROWS), math.ceil((size or 0) / bin_bytes))
    by_bytes = F.least("members", F.ceil(F.col("bytes") / block_bytes))
    blocks = F.greatest(F.ceil(F.col("members") / block), by_bytes).cast("int")
    own_block = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    small = (F.col("members") * 4 <= block) & (F.col("bytes") * 4 <= block_bytes)
    return (
        members.withColumn("blocks", blocks)
        .withColumn("block", own_block)
        .select("*", other)
        .withColumn("block_a", F.least("block", "other"))
        .withColumn("block_b", F.greatest("block", "other"))
        .withColumn(
            "bin",
            F.when(small, F.pmod(F.xxhash64("band", "hash"), F.lit(n_bins))).otherwise(
                F.xxhash64("band", "hash", "block_a", "block_b")
            ),
        )
        .select("node", "band", "hash", "block", "block_a", "block_b", "bin")
    )


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    ngram: int = NGRAM,
    recall: float = RECALL,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: row_id, doc_id, text_key, class_row, class_id, n_links, class_size, copies.

    ``n_links`` counts the other documents whose n-gram set has at least the threshold's similarity,
    copies included.  Documents connected by links have the same class; ``class_row`` is the stored
    row number of its first row and ``class_id`` its smallest doc_id.
    """
    steps = Steps(docs.sparkSession, "jaccard")
    bands, rows = choose_bands(threshold, recall)
    signed = steps.store(signatures(docs, ngram, bands, rows), "signatures")

    sets = ["set_a", "set_b", "n_grams"]
    first = F.min(F.struct("row_id", "doc_id", "text_key", "size", "bands"))
    classes = steps.store(
        signed.groupBy(*sets)
        .agg(first.alias("r"), F.count("*").alias("copies"))
        .select(*sets, F.col("r.row_id").alias("node"), "r.doc_id", "r.text_key", "r.size", "r.bands", "copies"),
        "classes",
    )
    banded = classes.filter("n_grams > 0").select("node", "size", F.posexplode("bands").alias("band", "hash"))
    gathered = (
        banded.groupBy("band", "hash")
        .agg(
            F.count("*").alias("members"),
            F.sum("size").alias("bytes"),
            F.min("node").alias("least"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all_nodes"),
        )
        .filter("members > 1")
    )
    kept = steps.store(
        gathered.groupBy("members", "least", "all_nodes")
        .agg(F.min(F.struct("band", "hash")).alias("b"), F.min("bytes").alias("bytes"))
        .select("b.band", "b.hash", "members", "bytes"),
        "kept",
    )
    members = steps.store(banded.join(kept, ["band", "hash"]), "members")
    wanted = steps.store(
        members.select("node").distinct().join(classes, "node").select(
            "node", F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "bands", "copies"
        ),
        "wanted",
    )
    slots = F.broadcast(wanted.select(slot(F.col("key")).alias("slot")).distinct())  # at most SLOTS integers
    texts = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
            text_key(F.col("text")).alias("text_key"),
        )
        .withColumn("slot", slot(F.col("text_key")))
        .join(slots, "slot", "left_semi")
    )
    fetched = (
        wanted.join(texts, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .select("node", "bands", "copies", "text")
        .dropDuplicates(["node"])  # rows that repeat both id and text
    )

    placed = _place(members, block, block_bytes)
    verified = steps.store(
        placed.join(fetched, "node")
        .groupBy("bin")
        .applyInPandas(lambda pdf: _verify(pdf, ngram, threshold), "node long, links long, root long"),
        "links",
    )
    roots = steps.store(components(steps, verified.select("node", "root")), "roots")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    described = (
        classes.select(*sets, "node", "copies")
        .join(roots, "node", "left")
        .join(counts, "node", "left")
        .select(
            *sets,
            F.coalesce("root", "node").alias("class_row"),
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    rows_of = steps.store(
        signed.select("row_id", "doc_id", "text_key", *sets).join(described, sets).drop(*sets), "rows"
    )
    named = (
        rows_of.groupBy("class_row")
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
        .filter("class_size > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = rows_of.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int"))
    return salted.join(named, ["class_row", "salt"], "left").select(
        "row_id",
        "doc_id",
        "text_key",
        "class_row",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        "n_links",
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "copies",
    )


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the first document of each class; all columns stay."""
    joined = Steps(docs.sparkSession, "classes").store(
        jaccard_join(docs, **options).select("row_id", "doc_id", "text_key", "class_row"), "joined"
    )
    keys = joined.groupBy("doc_id", "text_key").agg(
        F.max((F.col("row_id") == F.col("class_row")).cast("int")).alias("kept"), F.count("*").alias("rows")
    )
    left = without(docs, keys.filter("kept = 0"))
    # a pair of id and text that stays and stands in several rows keeps one of them
    several = keys.filter("kept = 1 AND rows > 1").select("doc_id", "text_key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    (row,) = free_names(docs, "row")
    once = (
        among(left, several)
        .select(F.struct(*columns).alias(row))
        .groupBy(F.col(f"{row}.doc_id").cast("long").alias("id"), text_key(F.col(f"{row}.text")).alias("key"))
        .agg(F.first(row).alias(row))
        .select(f"{row}.*")
    )
    return without(left, several).unionByName(once)
