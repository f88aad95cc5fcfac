"""A pipeline over documents: quality rules, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import line_dedup, mixing, ngram_join, packing, quality
from tracemill.llm.common import discard, stored, table

STAGES = [
    ("quality rules", quality.filter_stage),
    ("line dedup", line_dedup.dedup_stage),
    ("n-gram Jaccard join", ngram_join.near_dedup_stage),
    ("mixing sources", mixing.mix_stage),
    ("packing", packing.pack_stage),
]

#: Tokenization is beyond SQL; tests hold each stage against a brute-force version on what its predecessor kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the whole table documents; each stage's result is written and read again, until the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
