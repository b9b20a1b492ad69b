"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credtrace.llm import chat, decontaminate, hard_negatives, html_text, language_id, licences, line_dedup, minhash_join, mixing
from credtrace.llm import ngram_join, quality, token_align, toxicity
from credtrace.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.document_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_chars", "n_removed")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return chat.format_chat(talks, chat.declared_tools(talks))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


Q = {f.__name__: f for f in (op1_html_text, op2_licences, op3_line_dedup, op4_ngram_join, op5_decontamination, op6_language_id,
                               op7_mixing, op8_chat, op9_quality, op10_toxicity, op11_minhash, op12_hard_negatives, op13_token_align)}
ORACLE = {"op2_licences": licences.sql(), "op3_line_dedup": line_dedup.SQL, "op4_ngram_join": ngram_join.sql(),
          "op5_decontamination": decontaminate.SQL, "op7_mixing": mixing.sql(), "op9_quality": quality.SQL,
          "op11_minhash": minhash_join.sql(), "op12_hard_negatives": hard_negatives.SQL}
