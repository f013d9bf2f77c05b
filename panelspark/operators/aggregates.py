"""Averages and sums per entity, region, continent or year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import null_strict_sum, safe_ratio
from panelspark.operators.selection import Cohort, keep

TOTAL = "Overall"
ANNUAL = "Annual"


def cohort_average(
    panel: DataFrame,
    metric: str,
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Average of the non-zero values per entity, highest first; entities without one are absent."""
    rows = keep(panel, entities, since, until).filter(F.col(metric) != 0)
    return (
        rows.groupBy("entity")
        .agg(F.avg(metric).alias(f"avg_{metric}"))
        .orderBy(F.desc(f"avg_{metric}"), "entity")
    )


def annual_totals(household: DataFrame) -> DataFrame:
    """The yearly row of each region over all dwelling types, without the total region."""
    return household.filter(
        (F.col("region") != TOTAL)
        & (F.col("dwelling_type") == TOTAL)
        & (F.col("month") == ANNUAL)
        & (F.col("region") == F.col("description"))
    )


def regional_averages(household: DataFrame) -> DataFrame:
    """Yearly average per region, in no order: the input of further steps."""
    return (
        annual_totals(household)
        .groupBy("region", "year")
        .agg(F.avg("kwh_per_acc").alias("yearly_avg"))
    )


def period_average(household: DataFrame) -> DataFrame:
    """The report of :func:`regional_averages`, sorted."""
    return regional_averages(household).orderBy("region", "year")


def annual_rows_docs(docs: DataFrame) -> DataFrame:
    """(region, year, value) of the total month and total category of each year document."""
    total_month = F.get(F.filter("monthlyHouseholdConsumption", lambda m: m["is_total"]), F.lit(0))
    categories = docs.select("year", total_month["household_category"].alias("categories"))
    total = F.get(F.filter("categories", lambda c: c["household_type"] == TOTAL), F.lit(0))
    regions = categories.select("year", F.explode(total["regional_elect_data"]).alias("r"))
    return regions.filter(F.col("r.Region") != TOTAL).select(
        F.col("r.Region").alias("region"),
        F.col("year").cast("int").alias("year"),
        F.col("r.region_kwh_per_acc").alias("yearly_avg"),
    )


def period_average_docs(docs: DataFrame) -> DataFrame:
    """:func:`annual_rows_docs` pushed to one array per region, years ascending."""
    pair = F.struct("year", F.col("yearly_avg").alias("yearly_avg_kwh_per_acc"))
    return (
        annual_rows_docs(docs)
        .groupBy("region")
        .agg(F.array_sort(F.collect_list(pair)).alias("yearlyData"))
    )


def continent_mix(
    panel: DataFrame,
    entities: DataFrame,
    classes: Mapping[str, Sequence[str]],
    total: str,
    nonzero: str,
    shares: Mapping[str, str],
    since: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Average class totals per (continent, year) and their share of the average ``total``.

    A class total is NULL when one of its parts is; groups whose ``nonzero`` class averages to 0
    or NULL are dropped.  ``shares`` maps a result column to the class it is the share of.
    """
    members = entities.select("entity", "continent").filter(F.col("continent").isNotNull())
    rows = keep(panel, None, since, years=years).join(members, "entity")
    averages = rows.groupBy("continent", "year").agg(
        F.avg(total).alias("avg_total"),
        *[F.avg(null_strict_sum(list(parts))).alias(name) for name, parts in classes.items()],
    )
    return averages.filter(F.col(nonzero) != 0).select(
        "continent",
        "year",
        *classes,
        *[safe_ratio(of, "avg_total").alias(name) for name, of in shares.items()],
    )


def continent_average(panel: DataFrame, entities: DataFrame, metric: str) -> DataFrame:
    """Per continent the average of ``metric`` and of gdp / population, over rows with a gdp.

    The second is the mean of the ratios, not the ratio of the means.
    """
    members = entities.select("entity", "continent").filter(F.col("continent").isNotNull())
    return (
        panel.filter(F.col("gdp").isNotNull())
        .join(members, "entity")
        .groupBy("continent")
        .agg(
            F.avg(metric).alias(f"avg_{metric}"),
            F.avg(safe_ratio("gdp", "population")).alias("avg_gdp_per_capita"),
        )
    )


def emission_shares(
    emissions: DataFrame,
    parts: Sequence[str],
    total: str = "total",
    all_gases: str = "ghg",
    after: int | None = None,
) -> DataFrame:
    """Yearly sums and the ratios of those sums.

    ``fossil`` sums the row-wise totals of the parts, so a row lacking a part adds nothing to it.
    """
    rows = emissions if after is None else emissions.filter(F.col("year") > after)
    sums = rows.groupBy("year").agg(
        F.sum(null_strict_sum(list(parts))).alias("total_fossil"),
        F.sum(total).alias("total_co2"),
        F.sum(all_gases).alias("total_ghg"),
    )
    return sums.withColumns(
        {
            "fossil_co2_share": safe_ratio("total_fossil", "total_co2"),
            "fossil_ghg_share": safe_ratio("total_fossil", "total_ghg"),
            "co2_ghg_share": safe_ratio("total_co2", "total_ghg"),
        }
    )


def average_of_shares(shares: DataFrame) -> DataFrame:
    """Mean over the years of the yearly ratios of :func:`emission_shares`."""
    return shares.agg(
        F.avg("fossil_co2_share").alias("avg_fossil_co2_share"),
        F.avg("co2_ghg_share").alias("avg_co2_ghg_share"),
    )
