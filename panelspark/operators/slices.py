"""Slices of a panel, derived ratio and class columns, and threshold crossings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import null_strict_sum, percent, safe_ratio
from panelspark.operators.documents import metric_of, year_arrays
from panelspark.operators.selection import Cohort, keep

Pair = tuple[Column | str, Column | str]


def panel_slice(
    panel: DataFrame,
    metrics: Sequence[str],
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """(entity, year, metrics...) of the chosen entities and years."""
    return keep(panel, entities, since, until, years).select("entity", "year", *metrics)


def threshold_crossing(
    panel: DataFrame,
    metric: str,
    limit: float,
    components: Sequence[str] = (),
    entities: Cohort = None,
) -> DataFrame:
    """Years in which ``metric`` is strictly below ``limit`` (NULL is not), with its components.

    ``first_year`` is the first such year of the entity; the window holds at most one row per year.
    """
    below = keep(panel, entities).filter(F.col(metric) < limit)
    first = F.min("year").over(Window.partitionBy("entity"))
    return below.select("entity", "year", metric, *components, first.alias("first_year"))


def new_sources_docs(
    docs: DataFrame,
    crossing_metric: str,
    limit: float,
    key_pattern: str,
    excluded: Sequence[str],
    kind: str = "share",
    entities: Cohort = None,
) -> DataFrame:
    """One row per energy in use in the years in which ``crossing_metric`` is below ``limit``.

    Of each energy the ``kind`` object is opened and the first entry whose key matches
    ``key_pattern`` is taken; energies without a value, with 0 in either of the object's first two
    entries, or listed in ``excluded`` are left out.
    """
    years = keep(year_arrays(docs, [crossing_metric], energies=True), entities).select(
        "entity", F.explode("years").alias("y")
    )
    crossing = years.select(
        "entity",
        F.col("y.year").cast("int").alias("year"),
        metric_of(docs, F.col("y"), crossing_metric).alias("crossing_share"),
        F.col("y.energies").alias("energies"),
    ).filter(F.col("crossing_share") < limit)

    of_kind = F.get(F.filter("e.energyTypes", lambda t: t["type"] == kind), F.lit(0))["energyData"]
    unused = F.exists(F.slice(F.map_entries(of_kind), 1, 2), lambda x: F.coalesce(x["value"] == 0, F.lit(False)))
    entry = F.get(F.filter(F.map_entries(of_kind), lambda x: x["key"].rlike(key_pattern)), F.lit(0))
    return (
        crossing.select("entity", "year", "crossing_share", F.explode("energies").alias("e"))
        .filter(~F.col("e.energy").isin(list(excluded)) & ~F.coalesce(unused, F.lit(False)))
        .select(
            "entity", "year", "crossing_share", F.col("e.energy").alias("energy"),
            entry["value"].alias("energy_share"),
        )
        .filter(F.col("energy_share") != 0)
    )


def ratio_columns(
    df: DataFrame,
    ratios: Mapping[str, Pair] | None = None,
    percents: Mapping[str, Pair] | None = None,
) -> DataFrame:
    """Add ``name = a / b`` and ``name = 100 * a / b`` columns; NULL when the divisor is 0 or NULL."""
    return df.withColumns(
        {
            **{name: safe_ratio(a, b) for name, (a, b) in (ratios or {}).items()},
            **{name: percent(a, b) for name, (a, b) in (percents or {}).items()},
        }
    )


def group_sum_columns(df: DataFrame, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one total per class of metrics; NULL as soon as one of its metrics is NULL."""
    return df.withColumns({name: null_strict_sum(list(parts)) for name, parts in classes.items()})
