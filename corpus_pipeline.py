"""The corpus pipeline: stages over documents, each written and read again by the next.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All but the last return the columns
of ``documents``: the first, third and fourth leave rows out, the second shortens texts (a text may become empty, and the
third keeps one of these).  The last one gives the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import fold, read_table
from cohortspark.llm.decontaminate import without_leaks
from cohortspark.llm.lines import dedup_lines
from cohortspark.llm.nearcopies import keep_one_copy
from cohortspark.llm.packing import pack
from cohortspark.llm.quality import keep_quality, train_quality_model
from cohortspark.llm.queries import vocabulary
from cohortspark.session import staging_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of the corpus."""
    labels = read_table(spark, sf_dir, "labels")
    model = train_quality_model(read_table(spark, sf_dir, "documents"), labels.where(fold(F.col("doc_id"), 3) != 1))
    return keep_quality(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines."""
    edited = dedup_lines(docs)
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Documents are tied by fingerprints within two bits, found by covering masks as in ``op3_simhash``, or by 0.8 of their
    five-word shingles in common.
    """
    return keep_one_copy(docs, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage rests on a learned model and the last one on a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are stored below the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
