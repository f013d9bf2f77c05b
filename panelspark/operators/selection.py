"""Row selection shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Cohort = Sequence | DataFrame | None


def keep(
    df: DataFrame,
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
    years: Sequence[int] | None = None,
    entity: str = "entity",
    year: str = "year",
) -> DataFrame:
    """Rows of the given entities (a list, or a DataFrame with that column) and years.

    A list becomes an ``IN`` predicate the scan can use; a DataFrame becomes a semi join.
    """
    if since is not None:
        df = df.filter(F.col(year) >= since)
    if until is not None:
        df = df.filter(F.col(year) <= until)
    if years is not None:
        df = df.filter(F.col(year).isin(list(years)))
    if isinstance(entities, DataFrame):
        return df.join(entities.select(entity), entity, "left_semi")
    if entities is not None:
        df = df.filter(F.col(entity).isin(list(entities)))
    return df
