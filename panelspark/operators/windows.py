"""Moving averages, falling periods and year-on-year differences.

Windows are always partitioned by the entity and run over one row per (entity, year): a sort of
at most one element per year, however many raw rows stand behind the entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import period_label, window_frames
from panelspark.functions.nested import array_mean
from panelspark.operators.documents import metric_of, year_arrays
from panelspark.operators.selection import Cohort, keep


def _by_year(key: str, period: str = "year") -> Window:
    return Window.partitionBy(key).orderBy(period)


def moving_average(
    panel: DataFrame,
    metrics: Sequence[str],
    n: int,
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Average of each metric over ``n`` consecutive rows; the first ``n - 1`` rows are dropped.

    NULLs inside a frame are skipped.  All metrics share one window, hence one shuffle and sort.
    """
    ordered = _by_year("entity")
    frame = ordered.rowsBetween(-(n - 1), Window.currentRow)
    return (
        keep(panel, entities, since, until)
        .select(
            "entity",
            "year",
            period_label("year", n).alias("period"),
            *[F.avg(m).over(frame).alias(f"{m}_ma") for m in metrics],
            F.row_number().over(ordered).alias("row"),
        )
        .filter(F.col("row") >= n)
        .drop("row")
    )


def negative_change_pairs(
    panel: DataFrame,
    drop_metric: str,
    report_metric: str,
    n: int,
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Both periods of every fall in the moving average of ``drop_metric``.

    Each period appears once, with the moving average of ``report_metric`` over the same years;
    periods without one are dropped.  Both averages, the previous and the next value come from the
    same entity-partitioned order: a single shuffle, no self-join.
    """
    averages = moving_average(panel, [drop_metric, report_metric], n, entities, since, until)
    ordered = _by_year("entity")
    value = F.col(f"{drop_metric}_ma")
    return (
        averages.withColumns({"before": F.lag(value).over(ordered), "after": F.lead(value).over(ordered)})
        .filter((value < F.col("before")) | (value > F.col("after")))
        .filter(F.col(f"{report_metric}_ma").isNotNull())
        .select("entity", "period", f"{report_metric}_ma")
    )


def moving_average_docs(
    docs: DataFrame,
    required: str,
    n: int,
    details: Sequence[str] = (),
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """The moving average computed inside the year array of each document.

    Years without the ``required`` metric are dropped first and the frames slide over what
    is left.  Value and year stay in one struct, so a period cannot shift against its value.
    """

    def year_value(y: Column) -> Column:
        return F.struct(
            y["year"].alias("year"),
            metric_of(docs, y, required).alias("value"),
            *[metric_of(docs, y, d).alias(d) for d in details],
        )

    def usable(x: Column) -> Column:
        ok = x["value"].isNotNull()
        if since is not None:
            ok = ok & (x["year"] >= since)
        if until is not None:
            ok = ok & (x["year"] <= until)
        return ok

    def mean_of(frame: Column, name: str) -> Column:
        return array_mean(F.transform(frame, lambda x: x[name]))

    def average(frame: Column, last: Column) -> Column:
        return F.struct(
            last["year"].alias("year"),
            mean_of(frame, "value").alias(f"{required}_ma"),
            *[mean_of(frame, d).alias(f"{d}_ma") for d in details],
        )

    series = keep(year_arrays(docs, [required, *details]), entities).select(
        "entity", F.array_sort(F.filter(F.transform("years", year_value), usable)).alias("series")
    )
    frames = series.select("entity", F.explode(window_frames(F.col("series"), n, average)).alias("f"))
    return frames.select(
        "entity",
        F.col("f.year").cast("int").alias("year"),
        period_label("f.year", n).alias("period"),
        *[F.col(f"f.{m}_ma").alias(f"{m}_ma") for m in (required, *details)],
    )


def adjacent_pairs(df: DataFrame, key: str, period: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the row exactly one period earlier, as an array ordered by period.

    The distance is that of the values, not of the rows: after a gap the array holds the current
    row only.  With one row per period the frame ``[period - 1, period]`` can only hold the
    previous row and this one, so a look at the previous row replaces collecting the frame.
    """
    current = F.struct(period, *columns)
    previous = F.lag(current).over(_by_year(key, period))
    rows = df.select(key, period, current.alias("current"), previous.alias("previous"))
    is_adjacent = F.col(f"previous.{period}") == F.col(period) - 1
    pair = F.when(is_adjacent, F.array("previous", "current")).otherwise(F.array("current"))
    return rows.select(key, period, pair.alias("pair"))


def falling_pairs(
    df: DataFrame, key: str, period: str, drop_metric: str, report_metric: str
) -> DataFrame:
    """Members of adjacent pairs whose ``drop_metric`` falls, each period once.

    The value-distance counterpart of :func:`negative_change_pairs`.
    """
    pairs = adjacent_pairs(df, key, period, [drop_metric, report_metric])
    earlier, later = F.get("pair", F.lit(0)), F.get("pair", F.lit(1))
    falls = pairs.filter(
        (F.size("pair") == 2) & (earlier[drop_metric] > later[drop_metric])
    ).select(key, F.explode("pair").alias("p"))
    return (
        falls.select(key, F.col(f"p.{period}").alias(period), F.col(f"p.{report_metric}").alias(report_metric))
        .dropDuplicates([key, period])
        .filter(F.col(report_metric).isNotNull())
    )


def yoy_difference(
    averages: DataFrame,
    key: str,
    metric: str,
    period: str = "year",
    separator: str = "-",
    only_falls: bool = True,
) -> DataFrame:
    """Change against the previous row of the same key; by default only the falls."""
    change = F.col(metric) - F.lag(metric).over(_by_year(key, period))
    rows = averages.select(
        key, period, period_label(period, 2, separator).alias("duration"), change.alias("difference")
    )
    return rows.filter(F.col("difference") < 0) if only_falls else rows


def count_negative_years(falls: DataFrame, key: str, k: int | None = 3) -> DataFrame:
    """Keys by number of falls, most first; ``k`` limits the report, ties go to the first name."""
    counts = falls.groupBy(key).agg(F.count("difference").alias("instances"))
    ranked = counts.orderBy(F.desc("instances"), F.asc(key))
    return ranked if k is None else ranked.limit(k)
