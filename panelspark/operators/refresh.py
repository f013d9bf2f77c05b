"""What changed between two versions of a table, and a refresh that writes only changed partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.skew import same_keys_join
from panelspark.sources.tables import materialise, remove_partition


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows whose number differs, with ``change``: how many more of them ``new`` holds.

    Multisets are compared (``EXCEPT ALL`` in both directions) by one grouping of both tables, which
    sums within each task first; NULLs equal each other.
    """
    columns = old.columns
    both = old.select(*columns, F.lit(-1).cast("long").alias("change")).unionByName(
        new.select(*columns, F.lit(1).cast("long").alias("change"))
    )
    return both.groupBy(*columns).agg(F.sum("change").alias("change")).filter("change <> 0")


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key that was inserted, deleted or updated: ``keys``, ``kind`` and the changed columns.

    Both tables have one row per key.  ``columns`` lists, in order, the columns whose value differs (of
    an updated key only).
    """
    others = [c for c in old.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(True).alias("_here"), *others).alias(name))

    before = side(old, "before").withColumn("after", F.lit(None).cast(side(new, "r").schema["r"].dataType))
    after = side(new, "after").withColumn("before", F.lit(None).cast(side(old, "r").schema["r"].dataType))
    both = before.unionByName(after).groupBy(*keys).agg(
        F.max("before").alias("before"), F.max("after").alias("after")
    )
    differ = F.filter(
        F.array(
            *[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in others]
        ),
        lambda c: c.isNotNull(),
    )
    kind = (
        F.when(F.col("before").isNull(), "inserted")
        .when(F.col("after").isNull(), "deleted")
        .when(F.size(differ) > 0, "updated")
    )
    judged = both.select(*keys, kind.alias("kind"), differ.alias("columns")).filter("kind IS NOT NULL")
    return judged.withColumn("columns", F.when(F.col("kind") == "updated", F.col("columns")))


def refresh_partitions(spark: SparkSession, path: str, new: DataFrame, partition: str) -> list:
    """Brings the table at ``path`` to the version ``new``, and returns the partitions it wrote or removed.

    The table is stored by ``partition``.  Only partitions with a changed row are written again, each in
    whole; one that ``new`` no longer holds is removed; the files of all others stay as they are.  The
    changed rows are found and the new partitions written to the shared folder before the table is
    touched, so ``new`` may read the table, and a failure until then leaves it whole.
    """
    old = spark.read.schema(new.schema).parquet(path).select(*new.columns)
    changes = materialise(changed_rows(old, new).select(partition).distinct())
    rows = materialise(same_keys_join(new, changes, [partition], "left_semi"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    gone = same_keys_join(changes, rows.select(partition).distinct(), [partition], "left_anti")
    for (value,) in _values(gone, partition):
        remove_partition(spark, path, partition, value)
    return sorted((v for (v,) in _values(changes, partition)), key=lambda v: (v is not None, v))


def _values(partitions: DataFrame, column: str) -> list:
    """The names of partitions: as few as the table has folders, which any writer lists as well."""
    return [tuple(r) for r in partitions.select(column).take(partitions.count())]
