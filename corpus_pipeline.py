"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame;
:func:`run` writes what a stage returns and reads it again for the next one. No
rows give no rows in any stage. All stages but the last keep the columns of
their input, extra ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachgrid.llm import decontaminate, line_dedup, ngram_join, packing, quality
from reachgrid.llm.texts import free, read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules, fitted on the labels, do not reject.

    Null and empty texts fail the base rules and go; a null lang is a stratum of
    its own. Repeated rows go or stay together.
    """
    return quality.kept_of(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches.

    n_chars follows the text. A document of which no line with a word is left
    repeats others as a whole and goes; so does one without words whose lines
    were cut. All other columns stay as they are, whatever their names.
    """
    removed = free(docs, "_removed")
    cut = line_dedup.cut_lines(docs, written(line_dedup.repeated_lines(docs, num=80, den=100), "repeated-lines"), removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    words = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", " ")) != ""
    return cut.where((F.col(removed) == 0) | words).withColumn("n_chars", n_chars).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Null texts and texts without words are no duplicates and stay. Rows that
    repeat both doc_id and text are one document.
    """
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark; null texts and texts without words hold none."""
    return decontaminate.clean_of(docs, read(spark, sf_dir, "benchmark"), width=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins, of 16,384 byte tokens.

    A null or empty text is its end mark; repeated rows are packed apart.
    """
    return packing.pack(docs, packing.byte_length(F.col("text")), packing.exact_cluster(F.col("text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Cutoffs from binomial bounds and best-fit bins are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
