"""A training corpus from documents: quality, exact copies, near copies, repeated passages, packed sequences.

Null texts count as empty in every stage. Null ids stay as they are: a null id is the smallest to the exact dedup and
the last to the n-gram join. Rows that are repeated whole are copies, of which one stays. All but the last stage keep
the columns of their input, whatever their names; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import common, exact_dedup, ngram_join, packing, quality, suffix_dedup


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest doc_id of those with equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by similar 5-word shingles."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes covered by strings of 240 bytes, about fifty words, that occur again; no character is left in part."""
    return suffix_dedup.cut_documents(docs, suffix_dedup.PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, neighbours along a space-filling curve together."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_poor),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: No stage but exact dedup can be put in SQL; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
