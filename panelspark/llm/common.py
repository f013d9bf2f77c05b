"""Tables between the steps of an operator, and Arrow batches cut to a bounded number of bytes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SLOTS = 1 << 20  # bound on the rows of a broadcast that thins a scan
_own: list[str] = []
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets a folder of its own."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, where it is not installed on them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="llm-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{here.parent.name}-llm.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in [here.parent / "__init__.py", *sorted(here.glob("*.py"))]:
            out.write(path, path.relative_to(here.parent.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Steps:
    """Tables an operator writes between its steps, in the shared folder.

    A written table cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    values that depend on the placing of rows (row numbers) are fixed from then on.  `drop` removes
    those that the returned plan no longer reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        files, path = self._path("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # with all that is still there when the driver ends

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._path(name)
            files.delete(path, True)


def remainder_is_zero(doc_id: Column, by: int = 5) -> Column:
    """True where crc32 of the id's text leaves no remainder; a null id counts as trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by == 0, F.lit(False))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS)).cast("int")


def _keyed(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows that can't be among the (doc_id, text_key) pairs, and the others.

    A broadcast of at most SLOTS integers tells them apart, so that only the others are joined.  These
    have columns for the join.
    """
    at, key = free_names(docs, "slot", "key")
    slots = F.broadcast(keys.select(slot(F.col("text_key")).alias(at)).distinct())
    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(at, slot(F.col(key)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(slots, at, "left_anti").select(*columns), keyed.join(slots, at, "left_semi")


def _met(tested: DataFrame, docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    _, key, gone, gone_key = free_names(docs, "slot", "key", "gone", "gone_key")
    pairs = keys.select(F.col("doc_id").alias(gone), F.col("text_key").alias(gone_key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.col(key) == F.col(gone_key))
    return tested.join(pairs, same, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of the given (doc_id, text_key) pairs."""
    rest, tested = _keyed(docs, keys)
    return rest.unionByName(_met(tested, docs, keys, "left_anti"))


def among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are among the given (doc_id, text_key) pairs."""
    return _met(_keyed(docs, keys)[1], docs, keys, "left_semi")


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and where each begins; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, starts


def byte_slices(starts: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes; a longer text is a run of its own."""
    n = len(starts) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
