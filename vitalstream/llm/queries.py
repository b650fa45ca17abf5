"""The corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licences, lines, mixing, pages, quality, simhash, suffixes, surrogates, vectors
from .common import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.joined(table(spark, sf_dir, "embeddings"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"), "text")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), whole=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_simhash, op3_embeddings, op4_licences, op5_mixing, op6_lines, op7_pages, op8_surrogates, op9_decontamination, op10_quality)}
ORACLE_SQL: dict[str, str] = {}
