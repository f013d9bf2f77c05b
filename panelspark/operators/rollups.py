"""Totals over several levels of grouping at once: grouping sets, rollup and cube.

The rows are summed once, by all dimensions; every level is then summed from those sums.  So the raw
rows are shuffled once, a level's task reads at most as many rows as the finest level has groups, and
the grand total never sees raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of each aggregate: its states at the finest level, and how states merge.
_STATES = {
    "count": {"n": (F.count, F.sum)},
    "sum": {"s": (F.sum, F.sum)},
    "min": {"m": (F.min, F.min)},
    "max": {"m": (F.max, F.max)},
    "avg": {"s": (F.sum, F.sum), "n": (F.count, F.sum)},
}


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All leading parts of ``dims``, the longest first."""
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of ``dims``, the largest first."""
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def grouped_levels(
    df: DataFrame,
    dims: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    sets: Sequence[Sequence[str]],
) -> DataFrame:
    """One row per group of each of the ``sets`` of ``dims``, with the measures over the group's rows.

    ``measures`` maps a name to (aggregate, column): count, sum, min, max or avg.  A dimension that a
    set leaves out is NULL, and ``<dim>_total`` is 1 there; a NULL of the data has 0.  ``level`` holds the
    same as a number, the first dimension as the highest bit.  An empty table gives no rows, except for
    the grand total's, with a count of 0 and NULLs.
    """
    finest, merged, values = [], [], []
    for name, (kind, column) in measures.items():
        for part, (make, merge) in _STATES[kind].items():
            state = f"{name}__{part}"
            finest.append(make(column).alias(state))
            merged.append(merge(state).alias(state))
        if kind == "avg":
            whole = F.col(f"{name}__n").cast("double")
            values.append(F.try_divide(F.col(f"{name}__s").cast("double"), whole).alias(name))
        elif kind == "count":
            values.append(F.coalesce(f"{name}__n", F.lit(0).cast("long")).alias(name))
        else:
            values.append(F.col(f"{name}__{next(iter(_STATES[kind]))}").alias(name))
    sums = df.groupBy(*dims).agg(*finest)
    columns = [[F.col(c) for c in s] for s in sets]
    totals = [F.grouping(d).cast("int").alias(f"{d}_total") for d in dims]
    levels = sums.groupingSets(columns, *[F.col(d) for d in dims]).agg(*totals, *merged)
    level = sum((F.col(f"{d}_total") * (1 << k) for k, d in enumerate(reversed(dims))), F.lit(0))
    return levels.select(*dims, *[f"{d}_total" for d in dims], level.cast("int").alias("level"), *values)
