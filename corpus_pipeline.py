"""A cleaning pipeline over `documents`: language, quality, near-duplicates, packing.

Each stage gets what its predecessor kept; a stage's table is written and read again before the next one.
Stages decide row by row: rows with a null doc_id, and rows that repeat one, are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusveil.llm.common import cut, delete, fresh_dir, scratch, table
from corpusveil.llm.langid import decided
from corpusveil.llm.minhash import deduplicated
from corpusveil.llm.packing import pack
from corpusveil.llm.quality import passing
from corpusveil.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null or has no letter and those whose language stays undecided (score below 0.35)."""
    return decided(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail the rules (null and empty texts do), or whose host does; a null source is a host of its own."""
    return passing(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five-word shingles, similarity 0.8): the smallest doc_id, null ones last, one of repeated rows."""
    return deduplicated(docs, size=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row that is left into sequences of 1024 tokens; null texts as empty ones."""
    return pack(docs, tokenizer=tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2).withColumnRenamed("k", "doc_id")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicate), ("packing", packing)]

#: SQL cannot express the language and the packing stage; tests/llm/test_pipeline.py computes each stage's rows independently.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns the packed pieces. An empty table gives none."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), name, keep=True, path=path)
        if before:
            delete(spark, [before])
        before = path
    return docs
