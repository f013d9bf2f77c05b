"""Expressions over the nested documents (arrays of structs with sparse map leaves)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_entries(energies: Column) -> Column:
    """All ``(key, value)`` leaves of one year's energies, in document order."""
    per_energy = F.transform(
        energies,
        lambda e: F.flatten(F.transform(e["energyTypes"], lambda t: F.map_entries(t["energyData"]))),
    )
    return F.flatten(per_energy)


def first_metric(entries: Column, name: str) -> Column:
    """Value of the first leaf called ``name``; NULL when no leaf has that key."""
    return F.get(F.filter(entries, lambda x: x["key"] == F.lit(name)), F.lit(0))["value"]


def sort_by_field(array: Column, *fields: str) -> Column:
    """Sort an array of structs by integer or string fields (works when the structs hold maps)."""

    def compare(left: Column, right: Column) -> Column:
        order = F.lit(0)
        for field in reversed(fields):
            a, b = left[field], right[field]
            order = F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(order)
        return order

    return F.array_sort(array, compare)


def window_frames(array: Column, n: int, build: Callable[[Column, Column], Column]) -> Column:
    """``build(frame, last_element)`` for every full frame of ``n`` neighbours.

    NULL for an array shorter than ``n``: ``sequence`` would count down there.
    """
    starts = F.sequence(F.lit(0), F.size(array) - F.lit(n))
    frames = F.transform(
        starts,
        lambda i: build(F.slice(array, i + F.lit(1), F.lit(n)), F.get(array, i + F.lit(n - 1))),
    )
    return F.when(F.size(array) >= n, frames)


def array_mean(array: Column) -> Column:
    """Mean of the non-NULL elements; NULL when there is none."""
    present = F.filter(array, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(present))
