"""The training-text pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colonnade.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules  # noqa: E402
from colonnade.llm.queries import table, tokenizer_path  # noqa: E402
from colonnade.session import stage  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: enough words, little repetition, and a good calibrated score."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stood in an earlier text or place; documents of which nothing is left go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of five words and a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, percent=80, one_row=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that mostly are such passages go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark), ("packing", pack),
]

#: The first stage asks a trained classifier, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs)
    return docs
