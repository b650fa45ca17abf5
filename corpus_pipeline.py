"""From raw documents to a training mix: five stages, each an operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstream.llm import common, decontaminate, lines, mixing, quality, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at the cutoff or higher; fitted on labelled rows outside the held-out fold.

    A null text is scored as an empty one; without labels every document scores 0.5 and stays; no documents give none.
    """
    model = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).where(F.col("score") >= quality.CUTOFF).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, themselves or within one word. One that loses lines and keeps only blank ones goes.

    A null or empty text has no line to lose and stays; no documents give none.
    """
    found = lines.deduplicate_lines(docs, ("lang", "source"))
    found = found.where((F.col("n_exact") + F.col("n_near") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates: Jaccard 0.8 or more of five-word shingles. Rows of one doc_id stay or go together.

    A row without a doc_id stays; texts without words are equal to each other; no documents give none.
    """
    found = simhash.similar_documents(docs, words=5, similarity=0.8)
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["copy"], "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none; an empty benchmark takes nothing out."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies it takes of each.

    A document without words is never taken; a null source is a source; no documents give none.
    """
    found = mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))
    return found.where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
]
#: A fitted classifier, a set of trees and an edit search have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; what a stage stored on its way is removed."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        since = len(common.STORED)
        docs = common.stored(stage(spark, docs, sf_dir))
        common.forget(spark, since)
    return docs
