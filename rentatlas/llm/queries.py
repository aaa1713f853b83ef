"""One query per operator over its whole table, and the SQL those that SQL can express are checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rentatlas.llm import (
    alignment,
    chunks,
    infill,
    licenses,
    minhash,
    packing,
    pieces,
    pii,
    quality,
    simhash,
    toxicity,
    vertical,
    warc,
)
from rentatlas.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.sequences(licenses.scan(read_table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.find_repeats(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(read_table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_neighbours(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trees = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge_documents(docs, trees)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical.join_documents(read_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = infill.store(read_table(spark, sf_dir, "documents"))
    return infill.digests(infill.transform(stored))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_best_fit_packing, op2_licenses, op3_substring_dedup, op4_pii, op5_toxicity,
        op6_simhash, op7_warc, op8_sentencepiece, op9_minhash, op10_quality, op11_jaccard_join,
        op12_alignment, op13_infill,
    )
}

ORACLE: dict[str, str] = {
    "op2_licenses": licenses.oracle_sql(),
    "op11_jaccard_join": vertical.oracle_sql(),
    "op13_infill": infill.oracle_sql(),
}
