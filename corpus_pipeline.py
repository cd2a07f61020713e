"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

quality        documents that the classifier rejects go
near_dedup     of each group of near duplicates (five-word shingles, similarity 0.8) the document of least id stays
substring      words of passages that an earlier document has too go
contamination  documents that contain a benchmark item go
tokens         every document's text as byte-level BPE ids

Rows of one doc_id count as documents of their own, except that of a group only one stays. Rows with a null doc_id are no
near duplicates or sources of others and are judged like any row otherwise. The classifier scores a null text like an
empty one; where it stays, it stays null and has no tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import bpe, decontaminate, jaccard_join, quality, rlz_dedup
from strandlog.llm._shared import folder

STAGES = [
    ("quality", quality.stage),
    ("near_dedup", jaccard_join.stage),
    ("substring", rlz_dedup.stage),
    ("contamination", decontaminate.stage),
    ("tokens", bpe.stage),
]

#: The classifier and the tokenizer can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
