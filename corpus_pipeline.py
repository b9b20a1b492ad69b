"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credtrace.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from credtrace.llm.common import table, written

#: Sites that make a line boilerplate: above the 2 to 3 of plain copies, so that a hot source, whose copies are one site, hides no passage.
LINE_SITES = 4


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their cross-site boilerplate lines; every document stays."""
    return line_dedup.dedupe(docs, min_sites=LINE_SITES, count=None)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the training mix takes of each document, in training order."""
    return mixing.training_order(mixing.place(docs))


STAGES = [("toxicity", without_toxic), ("line_dedup", cross_site_lines), ("near_copies", without_near_copies),
          ("decontamination", without_benchmark), ("mixing", training_mix)]
#: Neither the classifier nor the written intermediate tables can be put into SQL; the tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
