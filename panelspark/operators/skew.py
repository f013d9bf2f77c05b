"""Joins that deal the rows of a hot key over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows of one key that a task takes in a salted join


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys equal each other; the result has the left one of each key."""
    renamed = right.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return left.join(renamed, condition, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def salted_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key and in ``count`` the key's rows.

    A key with more than ``hot_rows`` rows is dealt over as many parts as it has that many rows, by a
    hash of the whole row, and its fact is repeated once per part; other keys are joined plainly.
    So the facts grow by one row per ``hot_rows`` rows at most.  NULL keys join as a key of their own.
    """
    parts = F.ceil(F.col(count) / hot_rows).cast("int")
    hot = facts.filter(F.col(count) > hot_rows).select(*keys, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    dealt = same_keys_join(rows, hot, keys, "left").withColumn("_part", part).drop("_parts")
    spread = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return same_keys_join(dealt, spread, [*keys, "_part"]).drop("_part")
