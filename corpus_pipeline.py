"""Corpus preparation in stages; each works on all that its predecessor kept.

Columns of any name stay as they are, save text and n_chars where a stage says so. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import catalog, decontaminate, packing, quality, secrets, simhash
from panelspark.llm.common import delete
from panelspark.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs chosen on labelled ones.

    Null and empty texts fail the base rules. A null language is one of its own; null and repeated ids stay.
    """
    judged = quality.judge(docs, catalog.table(spark, sf_dir, "labels"), keep_columns=True)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest id.

    Null ids come last; of rows equal in id and text one stays. Texts without a word are linked like equal ones.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a window of one; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, catalog.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text, null texts and lengths stay null."""
    length = F.length("text").cast("long")
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, placed in sequences of 4096 tokens; a null text is empty, its end id alone."""
    return packing.pack(docs, catalog.TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# Fingerprints, alignments and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again, and goes once its successor is there."""
    docs, before = catalog.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
