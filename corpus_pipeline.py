"""From raw documents to packed sequences: quality rules, exact and near deduplication, personal data, packing.

Each stage takes any ``documents`` with doc_id, text and source; other columns, whatever their names, pass through
all but the last stage. Tables may be empty; texts null, empty or very long; rows may repeat. What each
stage does with such rows stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketwise.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from basketwise.llm.storage import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, and whose host does. Null and empty texts have no words and go; documents
    without a source are judged alone; repeated rows each count; a rate of exactly the threshold passes."""
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id, of rows that repeat it one; null counts as empty, null ids as least."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of the least id. Texts
    without words and rows without an id stay; rows that share an id stay or go together."""
    return near_dedup.representatives(docs, size=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it; all rows stay, null texts stay null."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end id; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", packed)]

#: Shingle similarity, Luhn checks of spans and a tokenizer's ids aren't for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
