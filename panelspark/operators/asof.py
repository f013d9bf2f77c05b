"""As-of join: each row with the last known row of another table at its time.

Both tables are merged in time order by key, and the last known row is carried along.  The order of a
key is cut into blocks of time, each a window of its own, so a key with a third of all rows is spread
over its blocks; what is known at the end of a block is carried into the later ones by a window over
one row per (key, block).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Block = Callable[[Column], Column]


def by_day(time: Column) -> Column:
    return F.date_trunc("day", time)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    columns: Sequence[str],
    tie: str,
    forward: bool = False,
    block: Block = by_day,
    within: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of its key at or before its time.

    Both tables have ``key`` and ``time``.  A right row at the very time of a left row counts; of
    several right rows of one time, the one with the largest ``tie`` does.  ``forward`` takes the first
    row at or after instead (largest ``tie`` again).  ``within(left time, right time)`` limits how far
    apart they may be.  Rows of ``left`` that find nothing stay, with NULLs; NULL keys or times find
    nothing and aren't found.  ``block`` maps a time to its block: it must not fall as time grows, and
    bounds what one task sorts to a key's rows within a block.
    """
    found = F.struct(F.col(time).alias("at"), *[F.col(c) for c in columns])
    known = (
        right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
        .groupBy(key, time)
        .agg(F.max_by(F.struct(*columns), F.struct(tie, *columns)).alias("r"))
        .select(key, time, *[F.col(f"r.{c}").alias(c) for c in columns])
        .select(key, time, found.alias("found"))
    )
    timed = F.col(key).isNotNull() & F.col(time).isNotNull()
    row = F.struct(*[F.col(c) for c in left.columns])
    asked = left.filter(timed).select(key, time, row.alias("row"))
    merged = (
        asked.withColumn("found", F.lit(None).cast(known.schema["found"].dataType))
        .unionByName(known.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)))
        .withColumn("block", block(F.col(time)))
    )

    direction = F.desc if forward else F.asc
    ends = merged.groupBy(key, "block").agg(
        (F.min_by if forward else F.max_by)("found", F.when(F.col("found").isNotNull(), F.col(time))).alias("end")
    )
    before = Window.partitionBy(key).orderBy(direction("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "block", F.last("end", ignorenulls=True).over(before).alias("carry"))

    # at one time the right row comes first
    ordered = Window.partitionBy(key, "block").orderBy(direction(time), F.col("row").isNotNull())
    last = F.last("found", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    in_block = merged.withColumn("last", last).filter("row IS NOT NULL").select(key, "block", "row", "last")
    joined = in_block.join(carried, [key, "block"], "left").select(
        "row", F.coalesce("last", "carry").alias("found")
    )
    near = F.lit(True) if within is None else within(F.col(f"row.{time}"), F.col("found.at"))
    values = [F.when(near, F.col(f"found.{c}")).alias(c) for c in columns]
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    return joined.select("row.*", *values).unionByName(left.filter(~timed).select(*left.columns, *nothing))
