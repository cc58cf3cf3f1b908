"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; the last returns a row for each piece of a document and its place in a training sequence. Columns beside
doc_id and text come out as they went in, whatever they are called; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import decontamination, packing, simhash, substring_dedup, toxicity
from linkweave.llm.common import stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null and empty texts have the classifier's bias as their score, so all stay or all go; equal texts share their lot,
    repeated rows too, and a text of any length is scored whole. Without labels a general list of words decides.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (null after all others), and
    among equal doc_ids the one whose text has the smallest hash.

    Of rows that are equal in both, one stays. All texts without words (null, empty, white space) have the fingerprint
    zero and so are one group, with texts whose fingerprints are that near to it. Texts of any length are compared whole.
    """
    return simhash.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again leave the texts; every document stays.

    Null texts stay null, texts shorter than a window stay as they are, and all occurrences of a passage go, those in
    repeated rows as well. A text that loses all of its words becomes empty; n_chars follows a text that changes.
    """
    return substring_dedup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; null items and items without letters and digits are found nowhere. Equal texts share
    their lot, and a text of any length is searched whole.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences.

    Null and empty texts are one end id; texts longer than a sequence are cut into pieces; repeated rows are each packed,
    and a null doc_id stays null.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: No SQL states these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
