"""The corpus pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import Scratch, prepare, table
from tidewright.llm.decontaminate import without_benchmark
from tidewright.llm.ngram_jaccard import drop_near_copies
from tidewright.llm.packing import pack
from tidewright.llm.pii import pseudonymise
from tidewright.llm.queries import TEST_KEY, TOKENIZER
from tidewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    prepare(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, k=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; the documents stay."""
    return pseudonymise(docs, TEST_KEY, counts=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 2048."""
    return pack(docs, TOKENIZER, capacity=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can't express the classifier and the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet to the shared folder and reread as the next one's docs.

    A stage's table is deleted when the next one's is written; the last stage writes what it needs before it returns.
    """
    docs, now = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        before, now = now, Scratch(spark)
        docs = now.table(stage(spark, docs, sf_dir), f"stage-{name}")
        before.clear()
    packed = STAGES[-1][1](spark, docs, sf_dir)
    now.clear()
    return packed
