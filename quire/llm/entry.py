"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, langid, licenses, linededup, minhash, mixing, phrases, quality, substrings, tokencount


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    x = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)
    return x.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("fits").alias("n_chars_within_limit"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=20)
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = linededup.without_common_lines(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_bpe_roundtrip": op2_bpe_roundtrip,
        "op3_chat_format": op3_chat_format,
        "op4_token_counts": op4_token_counts,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_near_copies": op8_near_copies,
        "op9_weighted_mix": op9_weighted_mix,
        "op10_language_id": op10_language_id,
        "op11_collocations": op11_collocations,
        "op12_filter_audit": op12_filter_audit,
        "op13_line_dedup": op13_line_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": chat.ORACLE_SQL,
        "op9_weighted_mix": mixing.ORACLE_SQL,
        "op11_collocations": phrases.ORACLE_SQL,
        "op12_filter_audit": audit.ORACLE_SQL,
        "op13_line_dedup": linededup.ORACLE_SQL,
    }
