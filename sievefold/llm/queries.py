"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, filter_audit, jaccard, langid, mixing, packing, quality, repetition, sharding, token_counts, topk, url_filter, vector_codes
from ._spark import crc_mod, table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return langid.identify(table(spark, sf_dir, "documents"), ~held_out, extra=[F.col("doc_id"), held_out.alias("held_out")])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda: F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~fold(), extra=[F.col("doc_id"), fold().alias("held_out")])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edits(table(spark, sf_dir, "documents"), token_counts.seeded_edits())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.windows(turns)).drop("n_windows")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), law="rows")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_repetition": repetition.oracle(), "op3_mixing": mixing.oracle(), "op4_topk": topk.oracle(), "op8_url_filter": url_filter.oracle(), "op11_vector_codes": vector_codes.oracle(), "op12_filter_audit": filter_audit.oracle()}
