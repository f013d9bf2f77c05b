"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups.

A group is all rows of one text; its size is that of its rows.  A group larger than a whole even share
can't be balanced, so it alone is cut into parts; there are fewer groups of that kind than shards.
All other groups stay in one shard.

Differencing runs from the large groups to the small ones.  The groups above a fiftieth of a share
come first: they are fewer than 50 * shards, whatever the data.  Every group starts as a partition
(its size, 0, ..., 0), and the two partitions with the largest spread are combined in opposite order
until one is left.  What the shards then hold is divided among the buckets of the next level.  A
bucket differences its groups, dealt by hash, together with its part of what is above it as one more
partition; that partition's slots are the shards, so the groups' shards are known at once and the
smaller groups make up for what the larger ones left uneven.  A level has up to FAN buckets for each
one above, and takes groups down to a size that bounds their number per bucket; the last level
takes the rest.  No task holds a number of groups that grows with the data.

Places within a shard are numbered from counts per (shard, chunk) of rows, so that no window holds a
shard.

Nulls: a null text has the size of an empty one and belongs to its group.  Repeated rows are rows of
their own.  Ties are broken by the groups' keys.  An empty table gives no rows.  Extra columns are not
read.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Steps

SHARDS = 40
OVERHEAD = 16  # bytes a row takes beside its text
BUCKET = 2000
FAN = 500
CHUNK_ROWS = 50_000
LARGE = 50  # groups above this part of a share come first


def difference(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partitions of equally many slots, each in descending order.

    Returns the sums of the last partition, in descending order, and for each given partition the
    final slot of each of its slots.
    """
    k = len(parts[0])
    sums: list[np.ndarray] = list(parts)
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(p[0] - p[-1]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        made.append((a, b, order))
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        sums.append(both)
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(sums) - 1))
    final: list[np.ndarray | None] = [None] * len(sums)
    final[-1] = np.arange(k)
    for node in range(len(sums) - 1, len(parts) - 1, -1):
        a, b, order = made[node - len(parts)]
        place = np.empty(k, np.int64)
        place[order] = final[node]  # slot s of a meets slot k-1-s of b
        final[a], final[b] = place, place[::-1]
        final[node] = None
    return sums[-1], np.stack(final[: len(parts)])


def _bucket(shards: int):
    """Differences the groups of a bucket with what its shards hold already (the row with a seed)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        held = pdf[pdf["seed"].notna()]["seed"]
        seed = np.asarray(held.iloc[0], np.int64) if len(held) else np.zeros(shards, np.int64)
        groups = pdf[pdf["key"].notna()].sort_values(
            ["size", "key", "part"], ascending=[False, True, True], kind="stable"
        )
        turn = np.random.default_rng(bucket).permutation(shards)  # which of equal shards comes first
        order = turn[np.argsort(-seed[turn], kind="stable")]
        single = np.zeros((len(groups), shards), np.int64)
        single[:, 0] = groups["size"]
        sums, final = difference([seed[order], *single])
        shard_of = np.empty(shards, np.int64)
        shard_of[final[0]] = order
        holds = np.empty(shards, np.int64)
        holds[shard_of] = sums
        out = pd.DataFrame(
            {
                "bucket": bucket,
                "key": groups["key"],
                "part": groups["part"].astype("int64"),
                "shard": shard_of[final[1:, 0]],
                "holds": None,
            }
        )
        total = pd.DataFrame({"bucket": [bucket], "key": None, "part": 0, "shard": 0, "holds": [holds]})
        return pd.concat([out, total], ignore_index=True)

    return run


def _part_of(step: int):
    return lambda held: F.floor(held / step)


def _levels(n: int, bucket: int, fan: int) -> list[int]:
    """Buckets of each level below the first, for n groups that the first does not take."""
    counts, buckets = [], 1
    while n > 0:
        step = min(fan, max(1, math.ceil(n / (bucket * buckets))))
        buckets *= step
        counts.append(buckets)
        if buckets * bucket >= n:
            break
    return counts


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    overhead: int = OVERHEAD,
    bucket: int = BUCKET,
    fan: int = FAN,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot (gapless from 0)."""
    steps = Steps(docs.sparkSession, "shard")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = steps.store(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(body, 256).alias("key"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt"),
        ),
        "rows",
    )
    grouped = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1.0, total / shards)
    oversize = steps.store(
        grouped.filter(F.col("bytes") > share).select(
            "key", F.ceil(2 * F.col("bytes") / share).cast("long").alias("parts")
        ),
        "oversize",
    )
    parted = rows.join(F.broadcast(oversize), "key", "left").withColumn(  # fewer rows than shards
        "part", F.coalesce(F.pmod("salt", F.col("parts")), F.lit(0).cast("long"))
    )
    groups = steps.store(parted.groupBy("key", "part").agg(F.sum("size").alias("size")), "groups")
    least = share / LARGE
    n_rest = groups.filter(F.col("size") <= least).count()
    below = _levels(n_rest, bucket, fan)
    nodes, above, most = None, 1, None
    parts = []
    for depth, buckets in enumerate([1, *below]):
        level = groups if most is None else groups.filter(F.col("size") <= most)
        most = least / buckets
        if depth < len(below):
            level = level.filter(F.col("size") > most)
        level = level.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))
        level = level.withColumn("seed", F.lit(None).cast("array<long>"))
        if nodes is not None:
            step = buckets // above
            child = F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("child")
            seeds = nodes.select("bucket", "holds", child).select(
                F.lit(None).cast("string").alias("key"),
                F.lit(0).cast("long").alias("part"),
                F.lit(0).cast("long").alias("size"),
                (F.col("bucket") + F.col("child") * above).alias("bucket"),
                F.transform("holds", _part_of(step)).alias("seed"),
            )
            level = level.unionByName(seeds)
        done = steps.store(
            level.groupBy("bucket").applyInPandas(
                _bucket(shards), "bucket long, key string, part long, shard int, holds array<long>"
            ),
            f"level-{depth}",
        )
        parts.append(done.filter("key IS NOT NULL").select("key", "part", "shard"))
        nodes, above = done.filter("holds IS NOT NULL").select("bucket", "holds"), buckets
    placed = reduce(DataFrame.unionByName, parts)
    chunks = max(1, math.ceil(n_rows / (shards * chunk_rows)))
    assigned = steps.store(
        parted.join(placed.select("key", "part", "shard"), ["key", "part"]).select(
            "doc_id",
            "size",
            "text_crc32",
            "salt",
            F.col("shard").cast("int"),
            F.pmod("salt", F.lit(chunks)).alias("chunk"),
        ),
        "assigned",
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        assigned.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "salt"))
    numbered = assigned.withColumn("within", within - 1).join(first, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot")
    )
