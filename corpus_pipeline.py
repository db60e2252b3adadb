"""Corpus pipeline: quality rules, near-duplicate removal, mixing of sources and packing, over all documents.

Each stage works on every row that its predecessor kept. The result has a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import common, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest accept.

    Null and empty texts fail the rules; repeated rows are all kept or none; an empty table gives an empty one.
    """
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, a similarity of 0.8).

    Null ids come last; of rows equal in id and text any one stays; null texts and those without words are one group;
    an empty table gives an empty one.
    """
    return simhash.deduplicated(docs, words=5, similarity=0.8, radius=None)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is a source of its own; documents without words stay once; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces.

    Repeats are packed as often as they are there; a null text is a piece of one id; an empty table gives an empty one.
    """
    return packing.packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicate removal", near_dedup), ("source mixing", source_mix), ("best-fit packing", best_fit_packing)]
#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it returned is written and reread."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            common.discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
