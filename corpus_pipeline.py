"""Corpus preparation: quality rules, near-duplicate removal, decontamination, masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last give the columns of ``documents``, other columns included if the table has any. No stage
needs unique or known ids, and an empty table comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import written
from marlstone.llm.contamination import keep_clean
from marlstone.llm.minhash import NearDuplicates, keep_one
from marlstone.llm.packing import default_tokenizer, pack
from marlstone.llm.pii import mask_pii
from marlstone.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands. Null, empty and short texts go;
    very long ones are judged whole and by pieces; repeated rows are judged each."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five-word shingles, similarity 0.8
    or more). Texts without a word, and rows without an id, stay; of rows that share an id all stay
    or go; very long texts count with all their shingles."""
    return keep_one(docs, NearDuplicates(words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and blank texts, and rows without an id, stay;
    rows that share an id go together; very long texts are searched whole."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked. A null text stays null; repeated rows are masked alike."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024. A null text counts as empty, one piece; repeated rows are
    packed each; longer texts are cut into pieces."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("masking", masking),
    ("packing", packing),
]

#: Compression, trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage
#: to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
