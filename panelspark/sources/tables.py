"""Scans with explicit schemas, and derived tables later queries read back."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.sources import schemas

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Where the present version of each derived table lies, by application and name.
_current: dict[tuple[str, str], str] = {}


def load(
    spark: SparkSession,
    directory: str,
    name: str,
    schema: StructType | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Scan ``<directory>/<name>.<fmt>`` with a fixed schema.

    The schema comes from :mod:`panelspark.sources.schemas` unless given, so no job is spent on
    inference and a changed file shows up as an error or NULLs rather than as a new type.  CSV columns
    are found by their names in the header, in any order and among others; a value that isn't of the
    declared type is NULL, and a missing column is an error.
    """
    schema = schema or schemas.TABLES[name]
    path = os.path.join(directory, f"{name}.{fmt}")
    if fmt == "csv":
        text = spark.read.options(**{"header": True, **options}).csv(path)
        missing = [f.name for f in schema if f.name not in text.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        return text.select(
            *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
        )
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def shared_directory(spark: SparkSession) -> str:
    """The cluster's shared folder for derived tables.

    Taken from ``spark.checkpoint.dir``.  Only a local session may fall back to a folder of its
    own: on a cluster a machine-local folder would be lost with the machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    return os.path.join(tempfile.gettempdir(), f"panelspark-{spark.sparkContext.applicationId}")


def _derived_directory(spark: SparkSession) -> str:
    return os.path.join(shared_directory(spark), "derived", spark.sparkContext.applicationId)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def release_derived(spark: SparkSession) -> None:
    """Remove every derived table of this application.  Plans that still read one fail afterwards."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _current if k[0] == application]:
        spark.catalog.dropTempView(key[1])
        spark.sql(f"DROP TABLE IF EXISTS `{key[1]}`")
        _delete(spark, _current.pop(key))
    _delete(spark, _derived_directory(spark))


def _written(df: DataFrame, path: str, partition_by: list[str] | None) -> DataFrame:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _owned(spark: SparkSession, path: str) -> str:
    """``path``, marked to be removed when the driver ends."""
    files, target = _file_system(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def save_derived(
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
    directory: str | None = None,
    buckets: int | None = None,
    bucket_by: str = "entity",
) -> DataFrame:
    """Write ``df`` now, replace what was there, and return a scan of the written table.

    The scan is also known by ``name`` to later SQL.  The written table survives lost executors
    and cuts the lineage of everything built on it.  It is written beside the one it replaces, which
    goes only once the name points to the new one: ``df`` may read the old table, and a failed write
    leaves it as it was.  The tables of an application are removed when its driver ends, or by
    :func:`release_derived`; those in a ``directory`` of the caller's stay.

    With ``buckets`` the rows of one ``bucket_by`` value lie in one bucket: later windows,
    groupings and joins on that column read the table without another shuffle.  Meant for panels,
    where one entity has at most one row per year.
    """
    spark = df.sparkSession
    version = f"{name}-{uuid.uuid4().hex}"
    path = os.path.join(directory or _owned(spark, _derived_directory(spark)), version)
    key = (spark.sparkContext.applicationId, name)
    if buckets is None:
        derived = _written(df, path, partition_by)
        if not spark.catalog.dropTempView(name):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        derived.createOrReplaceTempView(name)
    else:
        writer = df.repartition(buckets, bucket_by).write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        table = version.replace("-", "_")
        writer.bucketBy(buckets, bucket_by).option("path", path).saveAsTable(table)
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        spark.sql(f"ALTER TABLE `{table}` RENAME TO `{name}`")
        derived = spark.table(name).select(*df.columns)
    if key in _current:
        _delete(spark, _current[key])
    _current[key] = path
    return derived


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` now under a name of its own and return a scan of it.

    For plans that read the same derived table several times: its inputs are scanned once, and a
    lost executor costs a re-read of the written table, not a recomputation.  Removed like the
    tables of :func:`save_derived`.
    """
    spark = df.sparkSession
    path = os.path.join(_owned(spark, _derived_directory(spark)), f"once-{uuid.uuid4().hex}")
    return _written(df, path, None)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared one, removed like the tables of :func:`save_derived`."""
    return os.path.join(_owned(spark, _derived_directory(spark)), f"{name}-{uuid.uuid4().hex}")


def remove_partition(spark: SparkSession, path: str, column: str, value: object) -> None:
    """Remove one partition's folder of a stored table."""
    listed = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = listed.getPartitionPathString(column, None if value is None else str(value))
    _delete(spark, os.path.join(path, folder))


def save_view(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a view: evaluated anew by each query that reads it."""
    df.createOrReplaceTempView(f"`{name}`")
    return df
