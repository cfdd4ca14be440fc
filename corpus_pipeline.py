"""A corpus through five of the operators: what each stage keeps is all that the next one sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe, exact_dedup, mixing, near, quality
from framewright.llm.common import WIDE_GROUP, forget, mark, read_table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return quality.filter_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are equal but for white space."""
    return exact_dedup.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that share 0.8 of their five-word shingles."""
    return near.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: each copy of a document that the mix takes, in order of training position."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and seq, the place in the training sequence (from 0
    on; null if ``docs`` isn't the written table of the stage before), for each row."""
    lean = docs.select("doc_id", "text")
    return mixing.in_sequence(bpe.round_trip(mixing.stored(lean), beside=("at_file", "at_row")), lean)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

#: Scoring, fingerprints and encoding are not SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, WIDE_GROUP)
        forget(spark, since, mark() - 1)  # all but the stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
