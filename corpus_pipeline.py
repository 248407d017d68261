"""Corpus pipeline: quality filter, near-dedup, benchmark decontamination, encoding.

Each stage works on the rows its predecessor kept; all but the last return the columns of ``documents`` as they came. Other columns, whatever
their names, pass through. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, neardup, quality
from tessera.llm.queries import WORD_BPE
from tessera.session import settle, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside its held-out fold, predicts to be good.

    Null and empty texts are judged by the usual rates of a text; repeated rows stay or go together; a null doc_id is no reason to go.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null, empty and wordless texts are like nothing and stay; of repeated rows one stays; rows without a doc_id stay if no named row has their set, one of each set.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, whole or edited, of a benchmark item.

    Each row is judged by its own text; null and empty texts stay, repeated rows stay or go together, null and wordless items match nothing.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's number of ids and digests of the ids and of the text they decode to. Null and empty texts have no ids; repeated rows give a row each."""
    return bpe.round_trip(docs, WORD_BPE)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Classifier, sketches, alignment and encoding are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one hands on is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
