"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and works on all rows that the
stage before kept; each stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.packing import pack
from gleanery.llm.quality import keep_good
from gleanery.llm.simhash import drop_similar
from gleanery.llm.toxicity import drop_toxic
from gleanery.session import bounded_batches, delete_folder, shared_folder, shuffles_removed, table


def _sparing(stage):
    """The stage, with texts going to Python a few megabytes at a time and shuffle files removed when read; its result is computed later, under the same settings."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        bounded_batches(spark)
        shuffles_removed(spark)
        return stage(spark, docs, sf_dir)

    return run


@_sparing
def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@_sparing
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


@_sparing
def drop_near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, similarity=0.8, words=5)


@_sparing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids; ``packing.sequences`` joins and pads them."""
    return pack(docs, capacity=1024, min_cut=64, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("quality_rules", keep_good_documents),
    ("simhash_near_dedup", drop_near_duplicate_documents),
    ("packing", pack_sequences),
]

#: Tokenizers and trained models are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie as Parquet in the shared folder.

    The last stage keeps what it has tokenised in a checkpoint, so the Parquet files go when it is done.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    delete_folder(spark, folder)
    return docs
