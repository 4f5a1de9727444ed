"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import audit, chat, codes, cws, kdtree, langid, mixing, neardup, passages, pieces, secrets, templates, urls
from pairwright.llm.tables import cut, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, with the digest of what comes back.

    The ids are written between, so that no core runs two Python workers with a model each.
    """
    encoded = cut(pieces.encode(read(spark, sf_dir, "documents")))
    decoded = pieces.decode(encoded.withColumn("piece_ids", F.col("ids")))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    return decoded.select("doc_id", "n_chars", "n_tokens", "n_bytes", F.col("piece_ids").alias("ids"), digest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(chat.format_conversations(chat.turn_events(rows)))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_edited(read(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(read(spark, sf_dir, "pages"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_sentencepiece, op3_language_id, op4_exact_top_k, op5_url_filter, op6_chat_format,
        op7_fingerprint, op8_html_extract, op9_mix, op10_minhash_dedup, op11_vector_codes, op12_filter_audit,
        op13_repeated_passages,
    )
    return {f.__name__: f for f in every}
