"""Which entities are real, and which of them have a record in every period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import sort_by_field

# Fixed value: prefix of the codes that mark aggregates in the entity master.
AGGREGATE_PREFIX = "OWID"


def entity_master(entities: DataFrame, prefix: str = AGGREGATE_PREFIX) -> DataFrame:
    """Real entities: no aggregate code, and not a continent listed as its own member."""
    return entities.filter(
        ~F.col("code").like(f"{prefix}%") & (F.col("continent") != F.col("entity").cast("string"))
    )


def list_entities(panel: DataFrame, master: DataFrame, prefix: str = AGGREGATE_PREFIX) -> DataFrame:
    """Distinct (entity, code) of the panel that the entity master knows as real."""
    coded = panel.filter(~F.col("code").like(f"{prefix}%") & (F.col("code") != ""))
    return coded.select("entity", "code").distinct().join(
        master.select("entity").distinct(), "entity", "left_semi"
    )


def count_entities(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias("entities"))


def _span(first: Column, last: Column) -> list[Column]:
    return [
        first.cast("int").alias("min_year"),
        last.cast("int").alias("max_year"),
        (last - first + F.lit(1)).cast("int").alias("n_years"),
    ]


def year_span(panel: DataFrame) -> DataFrame:
    """First year, last year and the number of years between them, both included."""
    return panel.agg(*_span(F.min("year"), F.max("year")))


def full_coverage(panel: DataFrame, master: DataFrame) -> DataFrame:
    """Real entities with a record in every year of the span, with the counts as evidence.

    The span is computed from the panel as a scalar subquery, so nothing is cross-joined.
    """
    span = year_span(panel).select(F.col("n_years").cast("long")).scalar()
    return (
        panel.groupBy("entity")
        .agg(F.count("year").alias("n_years"))
        .filter(F.col("n_years") == span)
        .join(master.select("entity"), "entity", "left_semi")
    )


def year_span_docs(docs: DataFrame) -> DataFrame:
    """:func:`year_span` without unnesting: each document gives its own first and last year."""
    years = F.col("yearlyData.year")
    return docs.agg(*_span(F.min(F.array_min(years)), F.max(F.array_max(years))))


def full_coverage_docs(docs: DataFrame, master: DataFrame, span: Column | None = None) -> DataFrame:
    """Documents with one element per year of the span, their years sorted ascending.

    ``span`` is the number of years if it is known from elsewhere; the documents are then read once.
    """
    if span is None:
        span = year_span_docs(docs).select("n_years").scalar()
    return (
        docs.filter(F.size("yearlyData") == span)
        .withColumnRenamed("country", "entity")
        .join(master.select("entity"), "entity", "left_semi")
        .select("entity", sort_by_field(F.col("yearlyData"), "year").alias("yearlyData"))
    )
