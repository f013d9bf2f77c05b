"""Distinct counts and quantiles from stored sketches that merge for any slice.

One pass over the rows leaves a bounded state per (entity, period).  Later questions over any entities
and periods merge states and never see the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14  # 2**14 registers: a standard error of 0.6 %
QUANTILE_K = 400  # rank error of about 0.7 %


def sketch_states(
    df: DataFrame, keys: Sequence[str], distinct: str, value: str, lg_k: int = LG_K, k: int = QUANTILE_K
) -> DataFrame:
    """One row per group of ``keys``: number of rows, sketch of ``distinct``, sketch and bounds of ``value``.

    NULLs enter no sketch.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.hll_sketch_agg(F.col(distinct), F.lit(lg_k)).alias("distinct_state"),
        F.kll_sketch_agg_double(number, F.lit(k)).alias("quantile_state"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
    )


def merge_states(states: DataFrame, keys: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """States of coarser groups, of the same columns: merging is associative, so levels can be chained."""
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.hll_union_agg("distinct_state", F.lit(True)).alias("distinct_state"),
        F.kll_merge_agg_double(F.col("quantile_state"), F.lit(k)).alias("quantile_state"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def n_distinct() -> Column:
    """The estimated number of different values of a state."""
    return F.hll_sketch_estimate("distinct_state")


def quantile(fraction: float) -> Column:
    """The estimated value at this fraction of a state's rows; NULL where it has none."""
    if fraction <= 0:
        return F.col("least")
    if fraction >= 1:
        return F.col("most")
    known = F.kll_sketch_get_n_double("quantile_state") > 0
    return F.when(known, F.kll_sketch_get_quantile_double(F.col("quantile_state"), F.lit(float(fraction))))
