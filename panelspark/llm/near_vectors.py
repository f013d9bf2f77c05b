"""Near duplicates among embeddings by sorted projection passes.

Each distinct vector gets a sketch of sign bits of random projections, and in each pass a key of 64
further bits.  A pass puts the vectors in the lexicographic order of key and sketch, and compares each
with the WINDOW vectors before it by the number of differing bits.  The rows of a pass hold 40 bytes,
however long the vectors are.  Partitions are read in order; the first and last WINDOW rows of each
go into a second, small order, so pairs across a border are compared too.

What a window finds are only candidates.  They leave as groups, linear in the vectors; equal groups
of several passes are kept once.  The cosines of a group are then computed in double precision on the
vectors themselves, and only pairs that reach the threshold connect.  Large-star/small-star rounds
unite the verified pairs of all passes into components.  A window is bounded, so a vector with more
than WINDOW near copies doesn't meet them all: therefore the links are counted within whole
components, block against block, in tasks of at most 2 * BLOCK vectors.  Copies of a vector are one
row until the end.

The number of passes is not fixed.  A first order measures on how many leading bits a vector agrees
with its neighbour at the window's border; a pair at the threshold agrees on d bits with probability
(1 - angle / pi) ** d, which gives the passes that the target recall needs.  Up to WINDOW vectors, one
pass compares all pairs.

Vectors that are null, empty, zero or hold null or non-finite components have no links, and neither
have vectors of different lengths.  Each row is one vector: repeated rows and repeated ids are copies
or different vectors by their components.  The smallest vec_id names a component (null if none of its
rows has an id).  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import Steps, slot
from panelspark.llm.jaccard import components, connect
from panelspark.llm.wordhash import mix

THRESHOLD = 0.95
RECALL = 0.998
WINDOW = 512
SKETCH = 3  # 64-bit words of the sketch that all passes share
SCREEN = 1e-5  # chance that a pair at the threshold differs in too many bits
BLOCK = 4096  # vectors of a component compared with each other in one task
BIN_ROWS = 3000  # vectors of small groups that share a task's group
EDGE_ROWS = 1 << 20  # border rows put in order by one task; more are thinned in further rounds
SLICE = 512  # rows of the matrix of cosines held at a time
PER_TASK = 250_000  # rows of a narrow table that a task reads; a small one isn't spread over more tasks
LEAST_TASKS = 8
SALTS = 16  # parts that the rows of a vector's copies are split into when they meet its result

KEYS = ["k0", *[f"k{1 + w}" for w in range(SKETCH)]]
ORDER = ["dim", "pass", *KEYS]
SIGNED = "dim int, pass int, " + ", ".join(f"{k} long" for k in KEYS) + ", node long"
FOUND = f"group long, {SIGNED}"


def most_bits(bits: int, share: float, miss: float = SCREEN) -> int:
    """The least number that more of ``bits`` bits, each different with this chance, exceed with less than ``miss``."""
    below = 0.0
    for k in range(bits + 1):
        below += math.comb(bits, k) * share**k * (1 - share) ** (bits - k)
        if 1 - below <= miss:
            return k
    return bits


def choose_passes(depths: dict[int, int], threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met in a window with this recall.

    ``depths`` counts vectors by the leading bits on which they agree with the window's border.
    """
    total = sum(depths.values())
    same = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    passes = 1
    while sum(n * (1 - same**d) ** passes for d, n in depths.items()) > (1 - recall) * total:
        passes += 1
    return passes


def valid(vector: Column) -> Column:
    """True for vectors that have a direction."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(array: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, all of this length, scaled to length 1, in double precision."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bits(x: np.ndarray, seed: tuple[int, ...], words: int) -> np.ndarray:
    """Signs of 64 * words random projections, as 64-bit words whose first bit is the highest."""
    planes = np.random.default_rng([2025, *seed]).standard_normal((x.shape[1], 64 * words)).astype(np.float32)
    return np.packbits(x.astype(np.float32) @ planes > 0, axis=1).view(">i8").astype(np.int64)


def _sign(nodes: DataFrame, passes: int) -> DataFrame:
    """One row per vector and pass: key, sketch and node."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column("vector"), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 2048):
                    part = pa.array(own[at : at + 2048])
                    x = _unit(vectors.take(part), dim)
                    sketch, node = _bits(x, (dim,), SKETCH), batch.column("node").take(part)
                    for number in range(passes):
                        key = _bits(x, (dim, number), 1)
                        columns = [key[:, 0], *(sketch[:, w] for w in range(SKETCH))]
                        kinds = [np.full(len(x), v, np.int32) for v in (dim, number)]
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, kinds), *(pa.array(np.ascontiguousarray(c)) for c in columns), node],
                            names=[*ORDER, "node"],
                        )

    return nodes.select("node", "dim", "vector").mapInArrow(sign, SIGNED)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """Run, key words and node of each row, as columns of 64-bit integers."""
    dim, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "pass"))
    return np.stack([dim << 32 | number, *(batch.column(c).to_numpy() for c in (*KEYS, "node"))])


def _window(ordered: DataFrame, window: int, limit: int) -> DataFrame:
    """Candidate groups (group, node) of each partition's rows in order, and its border rows (group null)."""

    def candidates(rows: np.ndarray, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups among the rows whose pairs have a member from the row ``old`` on."""
        n = rows.shape[1]
        label = np.arange(n)
        words = rows[1:-1].view(np.uint64)
        for d in range(1, min(window, n - 1) + 1):
            first = max(old, d)
            differ = np.zeros(n - first, np.uint8)  # a sum of 256 wraps; the cosine refutes it
            for word in words:
                differ += np.bitwise_count(word[first:] ^ word[first - d : n - d])
            near = (differ <= limit) & (rows[0, first:] == rows[0, first - d : n - d])
            hit = np.flatnonzero(near) + first
            connect(label, hit - d, hit)
        size = np.bincount(label, minlength=n)
        member = np.flatnonzero(size[label] > 1)
        if len(member):
            node = rows[-1, member]
            content = np.zeros(n, np.uint64)  # the same members give the same name in every pass
            np.add.at(content, label[member], mix(node.view(np.uint64)))
            yield content[label[member]].view(np.int64), node

    def batch_of(group, rows) -> pa.RecordBatch:
        n = rows.shape[1]
        if group is not None:
            none = [pa.nulls(n, pa.int32())] * 2 + [pa.nulls(n, pa.int64())] * len(KEYS)
            return pa.RecordBatch.from_arrays([pa.array(group), *none, pa.array(rows[-1])], names=names)
        kinds = [pa.array((rows[0] >> 32).astype(np.int32)), pa.array(rows[0].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *kinds, *map(pa.array, rows[1:])], names=names)

    names = ["group", *ORDER, "node"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((len(KEYS) + 2, 0), np.int64)
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch)
            if seen < window:
                yield batch_of(None, np.ascontiguousarray(rows[:, : window - seen]))
            seen += rows.shape[1]
            rows = np.concatenate([carry, rows], axis=1)
            for group, node in candidates(rows, carry.shape[1]):
                yield batch_of(group, node[None, :])
            carry = rows[:, -window:]
        last = min(carry.shape[1], seen - window)  # those that are not among the first rows
        if last > 0:
            yield batch_of(None, np.ascontiguousarray(carry[:, -last:]))

    return ordered.mapInArrow(compare, FOUND)


def _depths(ordered: DataFrame, window: int, limit: int) -> DataFrame:
    """(depth, n): rows by the leading bits they share with the row ``window`` places on.

    At a partition's end the row takes the nearest border there is, which only adds passes.  Rows whose
    border is itself a near copy are left out: their copies are counted within the component.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(65, np.int64)

        def add(rows: np.ndarray, other: np.ndarray) -> None:
            words = rows[1:-1].view(np.uint64) ^ other[1:-1].view(np.uint64)
            far = np.bitwise_count(words).sum(axis=0, dtype=np.int64) > limit
            same = far & (rows[0] == other[0])
            bits = np.unpackbits(words[0, same].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[:] += np.bincount(np.where(bits.any(axis=1), bits.argmax(axis=1), 64), minlength=65)

        carry = np.zeros((len(KEYS) + 2, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([carry, _rows(batch)], axis=1)
            if rows.shape[1] > window:
                add(rows[:, :-window], rows[:, window:])
            carry = rows[:, -window:]
        if carry.shape[1] > 1:
            add(carry, np.repeat(carry[:, :1], carry.shape[1], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), pa.array(counts)], names=["depth", "n"])

    return ordered.mapInArrow(measure, "depth long, n long").groupBy("depth").agg(F.sum("n").alias("n"))


def _in_order(signed: DataFrame) -> DataFrame:
    return signed.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "node")


def candidate_groups(
    steps: Steps, nodes: DataFrame, passes: int, window: int, limit: int, edge_rows: int = EDGE_ROWS
) -> DataFrame:
    """(group, node): groups of vectors that some window holds as candidates."""
    found = steps.store(_window(_in_order(_sign(nodes, passes)), window, limit), "pass-0")
    groups, rows, k = found.filter("group IS NOT NULL"), None, 0
    while True:
        edges = found.filter("group IS NULL").drop("group")
        before, rows = rows, edges.count()
        last = rows <= edge_rows or (before is not None and 2 * rows > before)
        ordered = (
            edges.coalesce(1).sortWithinPartitions(*ORDER, "node")
            if last
            else edges.repartitionByRange(math.ceil(rows / (64 * window)), *ORDER).sortWithinPartitions(*ORDER, "node")
        )
        k += 1
        found = steps.store(_window(ordered, window, limit), f"pass-{k}")
        groups = groups.unionByName(found.filter("group IS NOT NULL"))
        if last:
            return groups.select("group", "node").distinct()


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of the table of pairs with a cosine of at least the threshold, and where each begins.

    A cosine within rounding of the threshold is computed again, in one order of summing for all.
    """
    for at in range(0, len(x), SLICE):
        cosine = x[at : at + SLICE] @ y.T
        linked = cosine >= threshold
        a, b = np.nonzero(np.abs(cosine - threshold) < 1e-9)
        for i in range(0, len(a), 1 << 15):
            u, v = x[at + a[i : i + (1 << 15)]], y[b[i : i + (1 << 15)]]
            linked[a[i : i + (1 << 15)], b[i : i + (1 << 15)]] = (u * v).sum(axis=1) >= threshold
        yield at, linked


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, root): a forest of the links within each candidate group."""
    nodes, roots = [], []
    for _, own in pdf.groupby(["group", "dim"], sort=False):
        node, x = own["node"].to_numpy(np.int64), _matrix(own["vector"])
        label = np.arange(len(own))
        for at, linked in _linked(x, x, threshold):
            a, b = np.nonzero(linked)
            later = b > a + at
            connect(label, a[later] + at, b[later])
        part = np.flatnonzero(label != np.arange(len(own)))
        nodes.append(node[part])
        roots.append(node[label[part]])
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"node": np.concatenate(nodes or none), "root": np.concatenate(roots or none)})


def _count(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links): the links of each node within its component's blocks, copies of others included."""
    nodes, counts = [], []
    for (_, block_a, block_b), own in pdf.groupby(["root", "block_a", "block_b"], sort=False):
        sides = [own[own["block"] == block] for block in dict.fromkeys((block_a, block_b))]
        xs = [_matrix(s["vector"]) if len(s) else np.zeros((0, 1)) for s in sides]
        weights = [s["copies"].to_numpy(np.int64) for s in sides]
        links = [np.zeros(len(s), np.int64) for s in sides]
        if all(map(len, xs)):
            for at, linked in _linked(xs[0], xs[-1], threshold):
                links[0][at : at + len(linked)] += linked @ weights[-1]
                if len(sides) > 1:
                    links[1] += weights[0][at : at + len(linked)] @ linked
        if len(sides) == 1:
            links[0] -= weights[0]  # a vector's cosine with itself
        nodes += [s["node"].to_numpy(np.int64) for s in sides]
        counts += links
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"node": np.concatenate(nodes or none), "links": np.concatenate(counts or none)})


def _with_vectors(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members`` with vector, dim and copies; a broadcast of at most SLOTS integers thins the vectors."""
    slots = F.broadcast(members.select(slot(F.xxhash64("node")).alias("slot")).distinct())
    wanted = nodes.withColumn("slot", slot(F.xxhash64("node"))).join(slots, "slot", "left_semi")
    return members.join(wanted.select("node", "dim", "vector", "copies"), "node")


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of about so many rows, in as few tasks as it needs."""
    return df.coalesce(max(LEAST_TASKS, rows // PER_TASK))


def _bins(rows: int) -> int:
    return max(1, math.ceil(rows / BIN_ROWS))


def near_vectors(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    window: int = WINDOW,
    block: int = BLOCK,
    passes: int | None = None,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept (it names its component).

    ``threshold`` is a positive cosine.  ``passes`` replaces the measured number of passes.
    """
    steps = Steps(embeddings.sparkSession, "vectors")
    element = embeddings.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if element in (T.FloatType(), T.DoubleType()) else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    keys = [F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b")]
    nodes = steps.store(
        rows.filter(valid(F.col("vector")))
        .groupBy("vector")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
        .select(
            F.monotonically_increasing_id().alias("node"),
            F.size("vector").alias("dim"),
            "vector",
            *keys,
            "first_id",
            "copies",
        ),
        "nodes",
    )

    limit = most_bits(64 * len(KEYS), math.acos(threshold) / math.pi)
    if passes is None:
        passes = 1
        if nodes.count() > window:
            depths = _depths(_in_order(_sign(nodes, 1)), window, limit).toPandas()  # 65 rows
            passes = choose_passes(depths.set_index("depth")["n"].to_dict(), threshold, recall)
    groups = steps.store(candidate_groups(steps, nodes, passes, window, limit, edge_rows), "groups")
    n_groups = groups.count()
    groups = _narrow(groups, n_groups)
    bins = F.pmod(F.xxhash64("group"), F.lit(_bins(n_groups)))
    edges = (
        _with_vectors(groups, nodes)
        .withColumn("bin", bins)
        .groupBy("bin")
        .applyInPandas(lambda pdf: _verify(pdf, threshold), "node long, root long")
    )
    edges = _narrow(steps.store(edges, "edges"), n_groups)
    roots = components(steps, edges, per_task=PER_TASK)
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    both = steps.store(_narrow(both, n_groups), "roots")
    sizes = both.groupBy("root").agg(F.count("*").alias("members"))
    members = steps.store(
        both.join(sizes, "root")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .withColumn("block_a", F.least("block", "other"))
        .withColumn("block_b", F.greatest("block", "other"))
        .select("root", "node", "members", "block", "block_a", "block_b"),
        "members",
    )
    small = F.pmod(F.xxhash64("root"), F.lit(_bins(members.count())))
    counts = (
        _with_vectors(members, nodes)
        .withColumn("bin", F.when(F.col("members") * 4 <= block, small).otherwise(F.xxhash64("root", "block_a", "block_b")))
        .groupBy("bin")
        .applyInPandas(lambda pdf: _count(pdf, threshold), "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )
    described = nodes.select("node", "a", "b", "first_id", "copies").join(both, "node", "left")
    names = described.filter("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("component_id"))
    results = steps.store(
        described.filter("copies > 1 OR root IS NOT NULL")
        .join(names, "root", "left")
        .join(counts, "node", "left")
        .select(
            "a",
            "b",
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "results",
    )
    salted = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    number = F.monotonically_increasing_id()
    has = valid(F.col("vector"))
    placed = rows.select(
        "vec_id",
        F.when(has, F.xxhash64("vector")).otherwise(number).alias("a"),  # those without links stay spread
        F.when(has, F.xxhash64("vector", F.lit(1))).alias("b"),
        F.pmod(number, F.lit(SALTS)).cast("int").alias("salt"),
    )
    found = placed.join(salted, ["a", "b", "salt"], "left").withColumn("linked", F.col("n_links").isNotNull())
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
