"""Row comparison shared by the tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.trade import tag_sides
from panelspark.sources.tables import load


def rows(df: DataFrame, columns: list[str] | None = None) -> list[tuple]:
    """Rows as tuples in a fixed order, columns by name."""
    names = columns or sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df: DataFrame) -> str:
    """The plan that actually ran, after adaptive execution."""
    df.collect()
    return plan(df).split("+- == Initial Plan ==")[0]


def same(a: list[tuple], b: list[tuple], tolerance: float = 1e-9) -> bool:
    """Equal rows, doubles within a relative tolerance."""

    def key(row):
        return tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)

    def equal(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return math.isclose(x, y, rel_tol=tolerance, abs_tol=1e-12)
        return x == y

    a, b = sorted(a, key=key), sorted(b, key=key)
    return len(a) == len(b) and all(
        len(x) == len(y) and all(equal(u, v) for u, v in zip(x, y, strict=True))
        for x, y in zip(a, b, strict=True)
    )


def trade_side(spark: SparkSession, directory: str, status: str) -> DataFrame:
    """Yearly quantity per product pair of one side: line status ``O`` imports, ``F`` exports."""
    lineitem = load(spark, directory, "lineitem").filter(F.col("l_linestatus") == status)
    part = load(spark, directory, "part")
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.year("l_shipdate").cast("int").alias("year"),
            F.col("p_type").alias("product"),
            F.col("p_brand").alias("sub_product"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def trade_from_sides(spark: SparkSession, directory: str) -> DataFrame:
    return tag_sides(trade_side(spark, directory, "O"), trade_side(spark, directory, "F"))
