"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next one. All but the last return the columns of documents. Models are fitted on the stage's own input.

1. language_id: null texts, texts without letters, and texts whose language stays doubtful go.
2. quality_rules: documents that fail the base rule or are more likely bad than good go.
3. near_dedup: of each group of near-duplicates the smallest doc_id stays.
4. substring_dedup: words of 13-word passages that a smaller doc_id has too go; a document left without words goes.
5. best_fit_packing: pieces of the texts in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import stages
from ledgerline.llm.common import ready, written

STAGES = [
    ("language_id", stages.language_id),
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Models, tokenizers and packing are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
