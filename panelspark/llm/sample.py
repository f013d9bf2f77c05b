"""Labelled texts to fit a classifier on: their ids, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import remainder_is_zero

SAMPLE_ROWS = 20_000


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(id, label) of all ids that are not held out; ids with contradicting or null labels are left out."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~remainder_is_zero(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most")
        .select("id", "label")
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label): at most ``rows`` distinct texts of labelled ids that are not held out.

    The ids come in the order of their hash, and so do the texts, one of each id before the others, so
    the choice does not depend on where rows lie and an id with many texts leaves room for all ids.
    Ids with contradicting labels, null labels and null texts are left out.
    """
    ids = labelled_ids(labels, label).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text IS NOT NULL")
    found = (
        texts.join(F.broadcast(ids), "id")
        .groupBy("text", "label")
        .agg(F.min("id").alias("id"))
        .withColumn("hash", F.xxhash64("id", "text"))
    )
    # only hashes are put in order, so no task gathers texts
    one = found.groupBy("id").agg(F.min("hash").alias("hash")).select("hash", F.lit(0).alias("turn"))
    others = found.select("hash").orderBy("hash").limit(rows).select("hash", F.lit(1).alias("turn"))
    chosen = one.union(others).groupBy("hash").agg(F.min("turn").alias("turn"))
    chosen = chosen.orderBy("turn", "hash").limit(rows).select("hash")
    return found.join(F.broadcast(chosen), "hash").select("text", "label")
