"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (
    decontaminate,
    extract,
    fill_middle,
    jaccard,
    near_vectors,
    packing,
    quality_model,
    quality_rules,
    search,
    secret_scans,
    shard,
    token_counts,
    toxicity,
)
from panelspark.llm.common import read, remainder_is_zero


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard.shard_rows(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _scored(docs: DataFrame, score, cut: float) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), score.alias("score"))
    return scored.select(
        "doc_id",
        remainder_is_zero(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.toxicity(docs, lexicon), 0.5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_join(read(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "class_size")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = quality_rules.apply_rules(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[f"quality.measures.{c}" for c in counts], "quality.base_failed", "quality.kept"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ranking = quality_model.learn(docs, read(spark, sf_dir, "labels"))
    return _scored(docs, quality_model.quality(docs, ranking), quality_model.CUT)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(read(spark, sf_dir, "documents"))
    kinds = [r[0] for r in secret_scans.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [_kind_count(kind) for kind in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scans.spelled(base), 256).alias("base_sha256"),
        secret_scans.spelled(F.col("spans")).alias("spans"),
    )


def _kind_count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = fill_middle.fill_in_middle(docs)
    restored = fill_middle.restore(F.col("fim.output"), F.col("fim.form"))
    return cut.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_toxicity,
        op3_decontamination,
        op4_jaccard_join,
        op5_quality_rules,
        op6_token_counts,
        op7_quality_classifier,
        op8_best_fit_packing,
        op9_secret_scans,
        op10_html_extraction,
        op11_embedding_near_dedup,
        op12_fill_in_middle,
        op13_lexical_search,
    )
}
