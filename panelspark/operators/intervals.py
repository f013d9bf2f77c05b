"""Interval join: pairs of overlapping half-open intervals ``[start, end)``, as an equi-join on buckets.

Each interval is put into the buckets it touches, and intervals meet in common buckets.  A pair that
shares several is kept in the first of them only.  The buckets are as wide as the mean interval, so
the intervals have at most two more bucket rows than intervals on average, however long some of them
are; a long interval is split in two steps, so that no row holds a list of all its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 1024  # buckets of an interval that are listed at once


def _sound(df: DataFrame) -> DataFrame:
    return df.filter(F.col("start") < F.col("end"))


def mean_width(left: DataFrame, right: DataFrame) -> Column:
    """The mean length of the intervals of both tables, at least 1, as a scalar subquery."""
    length = (F.col("end") - F.col("start")).alias("length")
    lengths = _sound(left).select(length).unionByName(_sound(right).select(length))
    mean = F.ceil(F.avg(F.col("length").cast("double"))).cast("long")
    return lengths.agg(F.greatest(F.coalesce(mean, F.lit(1)), F.lit(1)).alias("width")).scalar()


def _bucketed(df: DataFrame, width: Column) -> DataFrame:
    """One row per interval and bucket; ``first`` is the interval's first bucket."""
    sized = (
        _sound(df)
        .withColumn("width", width)
        .withColumn("first", F.floor(F.col("start") / F.col("width")).cast("long"))
        .withColumn("final", F.floor((F.col("end") - 1) / F.col("width")).cast("long"))
    )
    runs = sized.withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(final - first) div {RUN}")))
    )
    from_ = F.col("first") + F.col("run") * RUN
    upto = F.least(F.col("final"), from_ + (RUN - 1))
    return runs.withColumn("bucket", F.explode(F.sequence(from_, upto))).drop("run", "final", "width")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = (),
    width: Column | None = None,
) -> DataFrame:
    """Each pair of a left and a right interval that overlap, once: ``l``, ``r`` and the overlap's length.

    Both tables have whole numbers ``start`` and ``end`` and the ``keys`` on which pairs must also
    agree.  ``l`` and ``r`` are structs of all columns.  Intervals that only touch do not overlap.
    Empty intervals (``start >= end``), NULL bounds and NULL keys pair with nothing.  Repeated rows are
    intervals of their own.  Without ``width`` the buckets are as wide as the mean interval.
    """
    width = mean_width(left, right) if width is None else width

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in df.columns]).alias(name)
        keyed = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
        return _bucketed(df, width).select(row, *keyed, F.col("first").alias(f"{name}_first"), "bucket")

    on = [*[f"key_{i}" for i in range(len(keys))], "bucket"]
    met = side(left, "l").join(side(right, "r"), on)
    low, high = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    return met.filter(
        (F.col("bucket") == F.greatest("l_first", "r_first")) & (low < high)
    ).select("l", "r", (high - low).alias("overlap"))
