"""Ranks, tiles and percentiles over a whole table, without a window that holds it.

The rows are put in order by ranges, so that each part holds about as many rows, and written with the
number of their part.  One short row per part then tells where the part begins in the whole order, and
which value its neighbours end or begin with; the ranks inside a part are a window over the part, moved by
what lies before it.  Ties may cross any number of parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.tables import materialise

def _parts(placed: DataFrame) -> DataFrame:
    """Per part of the order: rows before it, values before it, and the ties at its ends.

    The table has one row per part.  Its running sums are taken over the list of all parts in one
    row, which is as short as the order has parts.
    """
    own = placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("fresh"), 1)).alias("n_values"),
        F.min_by("value", "place").alias("first"),
        F.max_by("value", "place").alias("last"),
        F.max(F.when(F.col("fresh"), F.col("place"))).alias("last_begin"),
        F.min(F.when(F.col("ends"), F.col("place"))).alias("first_end"),
    )
    # forwards: rows and values before the part, and where the value at its border began
    state = F.struct(
        F.lit(0).cast("long").alias("rows"),
        F.lit(0).cast("long").alias("values"),
        F.lit(None).cast(placed.schema["value"].dataType).alias("last"),
        F.lit(0).cast("long").alias("began"),
        F.array().cast("array<struct<part:int,rows:bigint,values:bigint,joins:boolean,began:bigint,n_values:bigint>>").alias("out"),
    )

    def step(s: Column, p: Column) -> Column:
        joins = (s["rows"] > 0) & s["last"].eqNullSafe(p["first"])
        one_value = p["n_values"] == 1
        began = F.when(joins & one_value, s["began"]).otherwise(s["rows"] + p["last_begin"])
        row = F.struct(
            p["part"].alias("part"),
            s["rows"].alias("rows"),
            (s["values"] - joins.cast("long")).alias("values"),
            joins.alias("joins"),
            s["began"].alias("began"),
            p["n_values"].alias("n_values"),
        )
        return F.struct(
            (s["rows"] + p["n"]).alias("rows"),
            (s["values"] + p["n_values"] - joins.cast("long")).alias("values"),
            p["last"].alias("last"),
            began.alias("began"),
            F.concat(s["out"], F.array(row)).alias("out"),
        )

    # backwards: how many of the following rows still have the value the part ends with
    tail = F.struct(
        F.lit(None).cast(placed.schema["value"].dataType).alias("first"),
        F.lit(0).cast("long").alias("ties"),
        F.lit(False).alias("any"),
        F.array().cast("array<struct<part:int,ties:bigint>>").alias("out"),
    )

    def back(s: Column, p: Column) -> Column:
        joins = s["any"] & s["first"].eqNullSafe(p["last"])
        after = F.when(joins, s["ties"]).otherwise(F.lit(0).cast("long"))
        whole = p["n_values"] == 1
        return F.struct(
            p["first"].alias("first"),
            (p["first_end"] + F.when(whole, after).otherwise(F.lit(0).cast("long"))).alias("ties"),
            F.lit(True).alias("any"),
            F.concat(s["out"], F.array(F.struct(p["part"].alias("part"), after.alias("ties")))).alias("out"),
        )

    listed = own.agg(
        F.array_sort(
            F.collect_list(F.struct("part", "n", "n_values", "first", "last", "last_begin", "first_end"))
        ).alias("parts")
    )
    both = listed.select(
        F.aggregate("parts", state, step)["out"].alias("forward"),
        F.aggregate(F.reverse("parts"), tail, back)["out"].alias("backward"),
    )
    forward = both.select(F.inline("forward"))
    backward = both.select(F.inline("backward")).select(F.col("part").alias("part"), "ties")
    return forward.join(backward, "part")


def global_ranks(
    df: DataFrame, by: Sequence[str], tie: Sequence[str] = (), descending: bool = False, parts: int | None = None
) -> DataFrame:
    """``df`` with ``position``, ``rank``, ``dense_rank``, ``n_upto`` and ``total`` in the order of ``by``.

    ``position`` counts the rows from 1, those equal in ``by`` in the order of ``tie``; rows equal in
    ``by`` share a ``rank`` (with gaps) and a ``dense_rank`` (without); ``n_upto`` counts the rows up to
    and with the row's ties, ``total`` all rows.  NULLs tie with each other and come first, or last
    where the order is ``descending``.  If ``tie`` leaves rows equal, their positions are some order of
    theirs.  ``parts`` sets the number of ranges; by default Spark chooses it.
    """
    values = [F.desc(c) if descending else F.asc(c) for c in by]
    order = [*values, *[F.asc(c) for c in tie]]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    written = materialise(ranged.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("part")))
    value = F.struct(*[F.col(f"row.{c}") for c in by]).alias("value")
    fields = written.select("row", "part", value, *[F.col(f"row.{c}").alias(f"tie_{i}") for i, c in enumerate(tie)])
    in_part = Window.partitionBy("part")
    by_value = in_part.orderBy(F.desc("value") if descending else F.asc("value"))
    by_row = in_part.orderBy(
        F.desc("value") if descending else F.asc("value"), *[F.asc(f"tie_{i}") for i in range(len(tie))]
    )
    upto = F.count(F.lit(1)).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = fields.select(
        "row",
        "part",
        "value",
        F.row_number().over(by_row).cast("long").alias("place"),
        F.rank().over(by_value).cast("long").alias("own_rank"),
        F.dense_rank().over(by_value).cast("long").alias("own_dense"),
        upto.alias("own_upto"),
    )
    placed = materialise(
        ranked.withColumns(
            {"fresh": F.col("place") == F.col("own_rank"), "ends": F.col("place") == F.col("own_upto")}
        )
    )
    total = placed.agg(F.count(F.lit(1)).alias("total")).scalar()
    before, place = F.col("rows"), F.col("place")
    goes_on = F.when(F.col("own_dense") == F.col("n_values"), F.col("ties")).otherwise(F.lit(0).cast("long"))
    came_before = F.col("joins") & (F.col("own_dense") == 1)
    return placed.join(_parts(placed), "part").select(
        "row.*",
        (before + place).alias("position"),
        F.when(came_before, F.col("began")).otherwise(before + F.col("own_rank")).alias("rank"),
        (F.col("values") + F.col("own_dense")).alias("dense_rank"),
        (before + F.col("own_upto") + goes_on).alias("n_upto"),
        total.alias("total"),
    )


def ntile(n: int) -> Column:
    """The tile, 1 to ``n``, of a ranked row; the first tiles hold one row more where they can't be equal."""
    position, total = F.col("position") - 1, F.col("total")
    small = F.expr(f"total div {n}")
    large_rows = (total % n) * (small + 1)  # rows in the tiles that hold one more
    in_large = F.expr(f"(position - 1) div (total div {n} + 1)")
    in_small = (total % n) + F.floor((position - large_rows) / F.greatest(small, F.lit(1)))
    return (F.when(position < large_rows, in_large).otherwise(in_small) + 1).cast("int")


def percent_rank() -> Column:
    """The share of the other rows that come before a ranked row's value; 0 for a single row."""
    return F.coalesce(F.try_divide((F.col("rank") - 1).cast("double"), F.col("total") - 1), F.lit(0.0))


def cume_dist() -> Column:
    """The share of the rows up to and with a ranked row's value."""
    return F.col("n_upto").cast("double") / F.col("total")


def global_percentiles(df: DataFrame, value: str, fractions: Sequence[float], parts: int | None = None) -> DataFrame:
    """(fraction, percentile): exact percentiles of ``value``, interpolated between neighbouring rows.

    NULL values don't count.  A table without values gives no rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    ranked = global_ranks(known, ["value"], parts=parts).select("value", "position", "total")
    listed = F.array(*[F.lit(float(f)) for f in fractions])

    def near(f: Column) -> Column:
        at = f * (F.col("total") - 1) + 1
        return (F.floor(at) == F.col("position")) | (F.ceil(at) == F.col("position"))

    ends = ranked.withColumn("fraction", F.explode(F.filter(listed, near))).groupBy("fraction", "total").agg(
        F.min_by("value", "position").alias("low"), F.max_by("value", "position").alias("high")
    )
    at = F.col("fraction") * (F.col("total") - 1)
    return ends.select(
        "fraction", (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("percentile")
    )
