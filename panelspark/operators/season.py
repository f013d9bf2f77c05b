"""Quarterly profiles of monthly measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import date_quarter, quarter_of_month, text_bar
from panelspark.operators.aggregates import ANNUAL, TOTAL

# Housing types that are totals of others.
TOTAL_HOUSING = ("Overall", "Public Housing", "Private Housing")


def quarterly_by_date(household: DataFrame, pattern: str = "M/d/yyyy") -> DataFrame:
    """Quarterly average per (region, year); the quarter comes from a date held as text."""
    monthly = household.filter(
        (F.col("region") != TOTAL)
        & (F.col("month") != ANNUAL)
        & (F.col("dwelling_type") == TOTAL)
        & (F.col("region") == F.col("description"))
    )
    return monthly.groupBy("region", "year", date_quarter("month", pattern).alias("quarter")).agg(
        F.avg("kwh_per_acc").alias("avg_kwh")
    )


def quarterly_by_month(
    gas: DataFrame,
    key: str = "sub_housing_type",
    value: str = "kwh",
    excluded: Sequence[str] = TOTAL_HOUSING,
) -> DataFrame:
    """Quarterly average per (key, year); months that are not numbers and total keys are dropped."""
    monthly = gas.filter(~F.col(key).isin(list(excluded))).withColumn(
        "quarter", quarter_of_month("month")
    )
    return (
        monthly.filter(F.col("quarter").isNotNull())
        .groupBy(key, "year", "quarter")
        .agg(F.avg(value).alias("avg_kwh"))
    )


def scaled_bars(quarters: DataFrame, value: str = "avg_kwh", width: int = 100) -> DataFrame:
    """Add a text bar scaled between the lowest and the highest value of the whole table.

    Both bounds are scalar subqueries, which Spark merges into one evaluation.
    """
    bounds = quarters.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    return quarters.withColumn("bar", text_bar(value, low, high, width))


def nest_quarters(quarters: DataFrame, key: str, value: str = "avg_kwh") -> DataFrame:
    """key -> [year -> [quarter, value]], both levels ascending; at most four quarters per year."""
    years = quarters.groupBy(key, "year").agg(
        F.array_sort(F.collect_list(F.struct("quarter", value))).alias("quarters")
    )
    return years.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("year", "quarters"))).alias("years")
    )


def monthly_categories(docs: DataFrame) -> DataFrame:
    """(year, quarter, categories) of the months that are not totals."""
    months = docs.select("year", F.explode("monthlyHouseholdConsumption").alias("m"))
    return months.filter(~F.col("m.is_total")).select(
        F.col("year").cast("int").alias("year"),
        quarter_of_month("m.month_num").alias("quarter"),
        F.col("m.household_category").alias("categories"),
    )


def quarterly_rows_docs(docs: DataFrame) -> DataFrame:
    """Quarterly average per (region, year) over the total category of each month."""
    total: Column = F.get(
        F.filter("categories", lambda c: c["household_type"] == TOTAL), F.lit(0)
    )
    regions = monthly_categories(docs).select(
        "year", "quarter", F.inline(total["regional_elect_data"])
    )
    return (
        regions.filter(F.col("Region") != TOTAL)
        .groupBy(F.col("Region").alias("region"), "year", "quarter")
        .agg(F.avg("region_kwh_per_acc").alias("avg_kwh"))
    )


def quarterly_docs(docs: DataFrame) -> DataFrame:
    """The regional profile as documents."""
    return nest_quarters(quarterly_rows_docs(docs), "region")


def quarterly_gas_rows_docs(docs: DataFrame, excluded: Sequence[str] = TOTAL_HOUSING) -> DataFrame:
    """Quarterly town gas average per (housing type, year) from the year documents."""
    categories = monthly_categories(docs).select("year", "quarter", F.inline("categories"))
    return (
        categories.filter(
            F.col("quarter").isNotNull() & ~F.col("household_type").isin(list(excluded))
        )
        .groupBy(F.col("household_type").alias("sub_housing_type"), "year", "quarter")
        .agg(F.avg("avg_mthly_hh_tg_consp_kwh").alias("avg_kwh"))
    )


def quarterly_gas_docs(docs: DataFrame, excluded: Sequence[str] = TOTAL_HOUSING) -> DataFrame:
    """The town gas profile as documents."""
    return nest_quarters(quarterly_gas_rows_docs(docs, excluded), "sub_housing_type")
