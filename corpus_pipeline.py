"""A training corpus from raw documents: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, common, exact_dedup, mixing, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: Learned and iterative stages have no SQL form; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
