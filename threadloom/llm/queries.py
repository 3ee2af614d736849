"""The registered queries of this package: op1_... to op10_..., each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.shipping import ship

from . import chat, decontaminate, line_dedup, media, ngram_join, packing, quality, substring_dedup, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_examples(_table(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_clips(media.render(_table(spark, sf_dir, "embeddings")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.fuzzy_passages(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.toxic_passages(documents, model)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_documents(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_media": op6_media,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.EXAMPLES_SQL,
    "op6_media": media.CLIPS_SQL,
    "op3_line_dedup": line_dedup.DEDUP_SQL,
    "op7_ngram_join": ngram_join.DOCUMENTS_SQL,
}
