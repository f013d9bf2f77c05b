"""Frames by value: for each row, all rows of its key whose period is near its own.

A frame over repeated periods holds several rows of each period.  The rows of a key are never put
into one window: they are first summed up per (key, period), each sum is added to the frames it
belongs to, and the frames go back to the rows.  All three steps are groupings and equi-joins on (key,
period); a hot (key, period) is dealt over several tasks in the last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.skew import HOT_ROWS, salted_join, same_keys_join

# Of each aggregate: its state per period, how states merge, and its value.
_STATES = {
    "count": (lambda c: {"n": F.count(c)}, {"n": F.sum}, lambda s: F.coalesce(s["n"], F.lit(0).cast("long"))),
    "sum": (lambda c: {"s": F.sum(c)}, {"s": F.sum}, lambda s: s["s"]),
    "min": (lambda c: {"m": F.min(c)}, {"m": F.min}, lambda s: s["m"]),
    "max": (lambda c: {"m": F.max(c)}, {"m": F.max}, lambda s: s["m"]),
    "avg": (
        lambda c: {"s": F.sum(c), "n": F.count(c)},
        {"s": F.sum, "n": F.sum},
        lambda s: F.try_divide(s["s"].cast("double"), s["n"].cast("double")),
    ),
    "values": (
        lambda c: {"v": F.collect_set(c)},
        {"v": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))},
        lambda s: s["v"],
    ),
}


def _targets(period: str, lower: int, upper: int) -> Column:
    """The periods whose frames ``[target + lower, target + upper]`` hold a row, and its own period."""
    near = F.sequence(F.col(period) - F.lit(upper), F.col(period) - F.lit(lower))
    own = F.array(F.col(period))
    return F.explode(F.when(F.col(period).isNull(), own).otherwise(F.array_union(near, own)))


def _in_frame(period: str, target: str, lower: int, upper: int) -> Column:
    """False for the row that only tells that the target has rows of its own, outside its frame."""
    distance = F.col(period) - F.col(target)
    return F.col(period).isNull() | distance.between(lower, upper)


def _check(lower: int, upper: int) -> None:
    if lower > upper:
        raise ValueError("a frame runs from its lower to its upper bound")


def period_frames(
    df: DataFrame,
    key: str,
    period: str,
    measures: Mapping[str, tuple[str, str]],
    lower: int = -1,
    upper: int = 0,
) -> DataFrame:
    """One row per (key, period): each measure over the rows with a period in ``[period + lower, period + upper]``.

    ``measures`` maps a name to (aggregate, column), with the aggregates count, sum, min, max, avg and
    values (the different values, in order; for columns with few of them).  Column ``period_rows``
    counts the rows of the period itself.  Periods are whole numbers.  NULL periods form a frame of
    their own and NULL keys a key of their own, as in a window; NULL measures are skipped, and a sum
    of none is NULL.
    """
    _check(lower, upper)
    states, merged, values = [], [], []
    for name, (kind, column) in measures.items():
        make, merge, value = _STATES[kind]
        own = {f"{name}__{part}": c for part, c in make(F.col(column)).items()}
        states += [c.alias(part) for part, c in own.items()]
        held = _in_frame(period, "target", lower, upper)
        merged += [merge[part.rsplit("__", 1)[1]](F.when(held, F.col(part))).alias(part) for part in own]
        values.append(value({part.rsplit("__", 1)[1]: F.col(part) for part in own}).alias(name))
    by_period = df.groupBy(key, period).agg(F.count(F.lit(1)).alias("period_rows"), *states)
    added = by_period.withColumn("target", _targets(period, lower, upper))
    here = F.sum(F.when(F.col("target").eqNullSafe(F.col(period)), F.col("period_rows")))
    frames = added.groupBy(key, F.col("target").alias(period)).agg(here.alias("period_rows"), *merged)
    # a target without rows of its own is no row's frame
    return frames.filter("period_rows IS NOT NULL").select(key, period, "period_rows", *values)


def range_frame(
    df: DataFrame,
    key: str,
    period: str,
    measures: Mapping[str, tuple[str, str]],
    lower: int = -1,
    upper: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with each measure over the row's frame by value; see :func:`period_frames`."""
    frames = period_frames(df, key, period, measures, lower, upper)
    joined = salted_join(df, frames, [key, period], "period_rows", hot_rows)
    return joined.select(*df.columns, *measures)


def frame_members(
    df: DataFrame, key: str, period: str, columns: Sequence[str], lower: int = -1, upper: int = 0
) -> DataFrame:
    """One row per (key, period) with ``members``: its frame's rows, as structs in order of period and columns.

    The array form of a frame over repeated periods.  An array holds its whole frame, so this is for
    keys with a bounded number of rows per period; :func:`range_frame` has no such bound.
    """
    _check(lower, upper)
    member = F.struct(F.col(period), *[F.col(c) for c in columns if c != period])
    added = df.select(key, F.col(period), _targets(period, lower, upper).alias("target"), member.alias("member"))
    frames = added.groupBy(key, F.col("target").alias(period)).agg(
        F.array_sort(F.collect_list(F.when(_in_frame(period, "target", lower, upper), F.col("member")))).alias(
            "members"
        ),
        F.max(F.col("target").eqNullSafe(F.col(period)).cast("int")).alias("own"),
    )
    return frames.filter("own = 1").select(key, period, "members")


def falling_frames(df: DataFrame, key: str, period: str, metric: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows below every row of the period exactly one earlier: falls, where periods repeat."""
    before = df.groupBy(key, period).agg(F.min(metric).alias("least"), F.count(F.lit(1)).alias("rows"))
    before = before.filter(F.col(period).isNotNull())
    earlier = before.select(key, (F.col(period) + 1).alias(period), "least")
    facts = same_keys_join(before.select(key, period, "rows"), earlier, [key, period])
    joined = salted_join(df, facts, [key, period], "rows", hot_rows)
    return joined.filter(F.col(metric) < F.col("least")).select(*df.columns, F.col("least").alias(f"previous_{metric}"))
