"""Two-sided facts (imports and exports).

All operators take one long table ``(year, product, sub_product, side, value)`` with one row per
key and side; comparing the sides of a key with several rows on one side is an error, not a sum.  Rows
with a NULL key belong to no pair and no year.  Comparing the sides is then one grouping with map-side aggregation instead of a
join of two shuffled tables, and a hot product cannot fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORT = "import"
EXPORT = "export"
PAIR = ["year", "product", "sub_product"]


def tag_sides(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Two tables of the same shape as one, with the side in a column."""
    return imports.withColumn("side", F.lit(IMPORT)).unionByName(
        exports.withColumn("side", F.lit(EXPORT))
    )


def _of(side: str) -> Column:
    return F.when(F.col("side") == side, F.col("value"))


def _seen(side: str) -> Column:
    return F.count(F.when(F.col("side") == side, 1))


def two_sided_average(trade: DataFrame, both_sides: bool = True) -> DataFrame:
    """Average of each side per (product, sub-product).

    Averaging each side on its own equals averaging over the joined pairs, where every value of
    one side is repeated equally often.  ``both_sides=False`` keeps one-sided pairs with a NULL.
    """
    averages = trade.dropna(subset=["product", "sub_product"]).groupBy("product", "sub_product").agg(
        F.avg(_of(IMPORT)).alias("import_avg"), F.avg(_of(EXPORT)).alias("export_avg")
    )
    return averages.dropna(subset=["import_avg", "export_avg"]) if both_sides else averages


def matched_sides(trade: DataFrame) -> DataFrame:
    """(year, product, sub-product) present on both sides, with both values."""
    return (
        trade.dropna(subset=PAIR)
        .groupBy(*PAIR)
        .agg(
            F.sum(_of(IMPORT)).alias("import_value"),
            F.sum(_of(EXPORT)).alias("export_value"),
            _seen(IMPORT).alias("imports"),
            _seen(EXPORT).alias("exports"),
        )
        .filter((F.col("imports") > 0) & (F.col("exports") > 0))
        .withColumn("import_value", F.when(_repeated(), _refuse()).otherwise(F.col("import_value")))
        .withColumn("export_value", F.when(_repeated(), _refuse()).otherwise(F.col("export_value")))
        .drop("imports", "exports")
    )


def _repeated() -> Column:
    return (F.col("imports") > 1) | (F.col("exports") > 1)


def _refuse() -> Column:
    """Several rows of one key and side: which belong together isn't known."""
    key = F.concat_ws(", ", *[F.col(c).cast("string") for c in PAIR])
    return F.raise_error(F.concat(F.lit("several rows for one side of "), key)).cast("double")


def matched_difference(trade: DataFrame) -> DataFrame:
    """Export minus import per (year, product, sub-product), sorted."""
    difference = F.col("export_value") - F.col("import_value")
    return (
        matched_sides(trade).select(*PAIR, difference.alias("yearly_diff")).orderBy(*PAIR)
    )


def matched_difference_docs(docs: DataFrame) -> DataFrame:
    """The differences as documents: year -> products -> sub-products, read inside the arrays.

    The year documents already hold both values side by side, so nothing is regrouped; a pair
    with only one side keeps a NULL difference.
    """

    def sub(s: Column) -> Column:
        return F.struct(
            s["name"].alias("sub_product"),
            (s["exports_value_ktoe"] - s["imports_value_ktoe"]).alias("yearly_diff"),
        )

    def product(p: Column) -> Column:
        return F.struct(
            p["name"].alias("product"), F.transform(p["sub_products"], sub).alias("sub_products")
        )

    return docs.select("year", F.transform("energy_products", product).alias("products")).orderBy(
        "year"
    )


def years_with_many(trade: DataFrame, n: int) -> DataFrame:
    """Years with more than ``n`` pairs whose export exceeds the import."""
    surplus = matched_sides(trade).filter(F.col("export_value") - F.col("import_value") > 0)
    return (
        surplus.groupBy("year")
        .agg(F.count(F.lit(1)).alias("surplus_pairs"))
        .filter(F.col("surplus_pairs") > n)
    )


def yearly_totals(trade: DataFrame, since: int | None = None, empty_as_zero: bool = False) -> DataFrame:
    """Total of each side per year, for years both sides have.

    ``empty_as_zero`` is the document rule: a side without any value totals 0, and keeps its year.
    """
    rows = trade.filter("year IS NOT NULL") if since is None else trade.filter(F.col("year") >= since)
    totals = rows.groupBy("year").agg(
        F.sum(_of(IMPORT)).alias("total_import"),
        F.sum(_of(EXPORT)).alias("total_export"),
        _seen(IMPORT).alias("imports"),
        _seen(EXPORT).alias("exports"),
    )
    if empty_as_zero:
        totals = totals.fillna(0.0, subset=["total_import", "total_export"])
    else:
        totals = totals.filter((F.col("imports") > 0) & (F.col("exports") > 0))
    return totals.select("year", "total_import", "total_export")


def yearly_balance(trade: DataFrame, since: int | None = None, empty_as_zero: bool = False) -> DataFrame:
    """Export total minus import total per year."""
    balance = F.col("total_export") - F.col("total_import")
    return yearly_totals(trade, since, empty_as_zero).select("year", balance.alias("balance"))
