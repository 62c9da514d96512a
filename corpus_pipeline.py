"""The corpus pipeline: quality filter, exact dedup, near dedup, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents, the last one the packed pieces.  ``run`` applies them to ``documents``, each
result written as Parquet in the shared folder of ``spark.checkpoint.dir`` and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm.common import shared_folder, table
from loamgrid.llm.exact_dedup import keep_first_copies
from loamgrid.llm.mixing import mixed_rows
from loamgrid.llm.near_dedup import keep_one_of_each
from loamgrid.llm.packing import pack_in_order
from loamgrid.llm.quality import keep_good
from loamgrid.shipping import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(ship(spark), sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sources interleaved by their target weights."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, which follow the mixed order."""
    return pack_in_order(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained scores, signatures and subword ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    ship(spark)
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared}/corpus-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
