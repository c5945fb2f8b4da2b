"""Corpus pipeline: documents in, token ids out.

Each stage applies one operator to all that its predecessor kept. What a stage
returns is written to the shared folder and read again as the next one's input,
so the loss of an executor costs a stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from lexigrid.llm.common import read
from lexigrid.storage import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("byte_bpe", encode_bytes),
]

#: Trigram posteriors, rolling hashes and BPE merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, token_ids, n_tokens, round_trip)`` of the documents that all stages keep."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
