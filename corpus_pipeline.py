"""A training corpus from documents: five stages, each read from the files of the one before."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rentatlas.llm import chunks, minhash, packing, pii, toxicity
from rentatlas.llm.common import read_table
from rentatlas.session import shared_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; the documents stay."""
    return chunks.drop_repeats(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Learned scores, sampling and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
