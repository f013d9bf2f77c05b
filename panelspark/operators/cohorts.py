"""Ranking entities, and cohorts of the top k joined back to their panel rows.

A top-k is ``orderBy().limit(k)``: each task keeps k rows and only those meet.  The cohort has k
rows, so Spark's own size estimate makes every join with it a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import safe_ratio
from panelspark.operators.selection import Cohort, keep


def rank_entities(
    panel: DataFrame,
    score: Column,
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
    require: Sequence[str] = (),
    descending: bool = True,
    k: int | None = None,
) -> DataFrame:
    """Entities by the average of ``score``; NULL counts as lowest, ties go to the first name.

    Only rows where every column of ``require`` is known count.
    """
    rows = keep(panel, entities, since, until)
    if require:
        rows = rows.dropna(subset=list(require))
    averages = rows.groupBy("entity").agg(F.avg(score).alias("avg_score"))
    order = F.desc_nulls_last("avg_score") if descending else F.asc_nulls_first("avg_score")
    ranked = averages.orderBy(order, F.asc("entity"))
    return ranked if k is None else ranked.limit(k)


def members_of(entities: DataFrame, continent: str, master: DataFrame | None = None) -> DataFrame:
    """Entities of one continent, if ``master`` is given only its real ones."""
    members = entities.filter(F.col("continent") == continent).select("entity")
    return members if master is None else members.join(master.select("entity"), "entity", "left_semi")


def topk_rows(
    panel: DataFrame, cohort: DataFrame, metrics: Sequence[str | Column], since: int | None = None
) -> DataFrame:
    """Panel rows with a gdp of the cohort's entities."""
    rows = keep(panel, cohort, since).filter(F.col("gdp").isNotNull())
    return rows.select("entity", "year", *metrics)


def topk_yearly(
    panel: DataFrame, cohort: DataFrame, metric: str, since: int | None = None
) -> DataFrame:
    """Yearly averages of ``metric`` and of gdp / population over the cohort."""
    rows = keep(panel, cohort, since).filter(F.col("gdp").isNotNull())
    return rows.groupBy("year").agg(
        F.avg(metric).alias(f"avg_{metric}"),
        F.avg(safe_ratio("gdp", "population")).alias("avg_gdp_per_capita"),
    )


def topk_vs_benchmark(
    panel: DataFrame,
    cohort: DataFrame,
    members: DataFrame,
    label: str,
    metric: str,
    since: int | None = None,
) -> DataFrame:
    """Averages of each cohort entity, and one row ``label`` averaging over all ``members``.

    Duplicate rows are merged; the benchmark also counts rows without a gdp.
    """
    averages = [
        F.avg(metric).alias(f"avg_{metric}"),
        F.avg(safe_ratio("gdp", "population")).alias("avg_gdp_per_capita"),
    ]
    own = (
        keep(panel, cohort, since).filter(F.col("gdp").isNotNull()).groupBy("entity").agg(*averages)
    )
    benchmark = (
        keep(panel, members, since)
        .groupBy(F.lit(label).alias("entity"))
        .agg(*averages)
    )
    return own.unionByName(benchmark).distinct()
