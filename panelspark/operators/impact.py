"""Several sources side by side: aligned series and impact per continent.

Facts and country figures meet on the entity alone, so every fact counts once per year of its
entity.  That weighting is kept, but never by building the pairs: each side is first reduced to
counts and sums per entity, and the average over all pairs of (fact, year) follows from products
of those moments.  The joins then run 1:1 over entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import safe_ratio


def by_period(df: DataFrame, period: Column, **measures: Column) -> DataFrame:
    """Aggregate a dated source to one row per period."""
    return df.groupBy(period.alias("period")).agg(*[c.alias(n) for n, c in measures.items()])


def align_series(first: DataFrame, *others: DataFrame, on: str = "period", how: str = "left") -> DataFrame:
    """Sources with one row per ``on`` side by side; ``left`` keeps every period of the first."""
    return reduce(lambda left, right: left.join(right, on, how), others, first)


def align_two_key(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    since: int | None = None,
) -> DataFrame:
    """Average of both values per entity, ``right`` joined to ``left`` on entity and year."""
    if since is not None:
        left, right = (side.filter(F.col("year") >= since) for side in (left, right))
    joined = left.select("entity", "year", left_value).join(
        right.select("entity", "year", right_value), ["entity", "year"], "left"
    )
    return (
        joined.groupBy("entity")
        .agg(
            F.avg(left_value).alias(f"avg_{left_value}"),
            F.avg(right_value).alias(f"avg_{right_value}"),
        )
        .orderBy(F.desc(f"avg_{left_value}"), "entity")
    )


def validated_counts(facts: DataFrame, panel: DataFrame, label: str = "World") -> DataFrame:
    """Sum of ``value`` per (year, type) over facts whose (entity, year) the panel has.

    Facts are summed per (entity, year, type) before they are shuffled for the semi join.
    """
    keyed = facts.groupBy("entity", "year", "type").agg(F.sum("value").alias("value"))
    known = panel.select("entity", "year")
    return (
        keyed.join(known, ["entity", "year"], "left_semi")
        .groupBy("year", "type")
        .agg(F.sum("value").alias("total"))
        .withColumn("scope", F.lit(label))
    )


def _continent_of(entities: DataFrame) -> DataFrame:
    return entities.select("entity", "continent")


def _inverse(divisor: str) -> Column:
    return safe_ratio(F.lit(1.0), divisor)


def _moments(df: DataFrame, prefix: str, **values: Column) -> DataFrame:
    """Rows per entity, and count and sum of each value over its non-NULL rows."""
    return df.groupBy("entity").agg(
        F.count(F.lit(1)).cast("double").alias(f"{prefix}_rows"),
        *[F.sum(v.cast("double")).alias(f"{n}_sum") for n, v in values.items()],
        *[F.count(v).cast("double").alias(f"{n}_n") for n, v in values.items()],
    )


def _mean(total: Column, count: Column) -> Column:
    return safe_ratio(F.sum(total), F.sum(count))


def continent_exposure(exposure: DataFrame, master: DataFrame, value: str) -> DataFrame:
    """Average share below and above the line per continent of the real entities."""
    below = _mean(F.col("exposed_sum"), F.col("exposed_n"))
    return (
        _moments(exposure, "exposure", exposed=F.col(value))
        .join(_continent_of(master), "entity")
        .groupBy("continent")
        .agg(below.alias("below"), (F.lit(100.0) - below).alias("above"))
        .orderBy(F.desc_nulls_last("below"), "continent")
    )


def continent_impact(
    facts: DataFrame,
    info: DataFrame,
    master: DataFrame,
    value: str = "displacements",
    exposure: DataFrame | None = None,
    exposed: str = "exposed",
) -> DataFrame:
    """Continent averages of ``value``, population, their ratio in percent and gdp per capita.

    ``info`` (entity, year, population, gdp) and the optional ``exposure`` are joined on the
    entity only; entities they lack keep their facts.
    """
    per_entity = (
        _moments(facts, "fact", fact=F.col(value))
        .join(_continent_of(master), "entity")
        .join(
            _moments(
                info,
                "info",
                population=F.col("population"),
                inverse=_inverse("population"),
                per_capita=safe_ratio("gdp", "population"),
            ),
            "entity",
            "left",
        )
    )
    if exposure is not None:
        per_entity = per_entity.join(_moments(exposure, "exposure", exposed=F.col(exposed)), "entity", "left")
        exposures = F.coalesce("exposure_rows", F.lit(1.0))
    else:
        exposures = F.lit(1.0)
    facts_, infos = F.col("fact_rows"), F.coalesce("info_rows", F.lit(1.0))

    def total(name: str, weight: Column) -> Column:
        return _mean(F.col(f"{name}_sum") * weight, F.col(f"{name}_n") * weight)

    columns = [
        total("fact", infos * exposures).alias(f"avg_{value}"),
        total("population", facts_ * exposures).alias("avg_population"),
        (
            F.lit(100.0)
            * _mean(
                F.col("fact_sum") * F.col("inverse_sum") * exposures,
                F.col("fact_n") * F.col("inverse_n") * exposures,
            )
        ).alias(f"pct_{value}"),
        total("per_capita", facts_ * exposures).alias("avg_gdp_per_capita"),
    ]
    if exposure is not None:
        columns.append(total("exposed", facts_ * infos).alias(f"avg_{exposed}"))
    return (
        per_entity.groupBy("continent")
        .agg(*columns)
        .orderBy(F.desc_nulls_last(f"avg_{value}"), "continent")
    )


def loss_above_average(losses: DataFrame, info: DataFrame, value: str = "loss") -> DataFrame:
    """Per entity the average loss, population, gdp and loss in percent of gdp.

    Only years with at least the overall average population count; that average is a scalar
    subquery, which the scan of ``info`` can use as a filter.
    """
    average = info.agg(F.avg("population")).scalar()
    big_years = info.filter(F.col("population") >= average)
    years = _moments(
        big_years, "info", population=F.col("population"), gdp=F.col("gdp"), inverse=_inverse("gdp")
    )
    joined = _moments(losses, "loss", loss=F.col(value)).join(years, "entity")

    def mean(name: str) -> Column:
        return safe_ratio(f"{name}_sum", f"{name}_n")

    pct = F.lit(100.0) * safe_ratio(
        F.col("loss_sum") * F.col("inverse_sum"), F.col("loss_n") * F.col("inverse_n")
    )
    return joined.select(
        "entity",
        mean("loss").alias("avg_loss"),
        mean("population").alias("avg_population"),
        mean("gdp").alias("avg_gdp"),
        pct.alias("pct_loss"),
    ).orderBy(F.desc_nulls_last("pct_loss"), "entity")
