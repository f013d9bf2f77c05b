"""The first n rows of each entity, without sorting the entities whole.

Each task keeps the first n rows of each entity it meets, before anything is shuffled.  An entity's rows are
dealt over parts, each part keeps its first n, and the last step sees at most n rows of each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 16


def top_rows(
    df: DataFrame, key: str, order: Sequence[str], n: int, descending: bool = True, parts: int = PARTS
) -> DataFrame:
    """``df``'s first ``n`` rows of each ``key`` in the order of the columns ``order``, with their ``place``.

    NULLs count as smallest.  Rows equal in all of ``order`` are placed in the order of the other
    columns, as far as these can be ordered.  NULL is a key of its own.
    """
    direction = F.desc if descending else F.asc
    others = [c for c in df.columns if c not in (key, *order)]
    ordered = [*[direction(c) for c in order], *[F.asc(c) for c in others]]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts).cast("long"))
    near = Window.partitionBy(key, "_part").orderBy(*ordered)
    whole = Window.partitionBy(key).orderBy(*ordered)
    kept = df.withColumn("_part", part).withColumn("place", F.row_number().over(near)).filter(F.col("place") <= n)
    return kept.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= n).drop("_part")


def top_lists(
    df: DataFrame, key: str, order: Sequence[str], n: int, descending: bool = True, parts: int = PARTS
) -> DataFrame:
    """One row per ``key``: ``rows``, an array of the first ``n`` rows as structs, in order."""
    others = [c for c in df.columns if c != key]
    placed = top_rows(df, key, order, n, descending, parts)
    member = F.struct("place", *others)
    rows = F.transform(
        F.array_sort(F.collect_list(member)), lambda r: F.struct(*[r[c].alias(c) for c in others])
    )
    return placed.groupBy(key).agg(rows.alias("rows"))
