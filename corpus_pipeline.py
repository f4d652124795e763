"""The corpus pipeline: five stages, each on all that its predecessor kept of ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Written as Parquet, a result is the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import scratch_table, table
from cohortlake.llm.decontamination import find_leaks
from cohortlake.llm.mixing import TARGETS, labelled_languages, mixed
from cohortlake.llm.near_dedup import near_duplicates
from cohortlake.llm.quality import fit_quality, quality_filtered
from cohortlake.llm.token_store import default_vocabulary, tokenized


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose compression score calls them bad."""
    return quality_filtered(docs, fit_quality(docs, table(spark, sf_dir, "labels")), 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest identifier.

    Five-word shingles, similarity 0.8. Of rows that repeat a document whole one stays; rows
    without an identifier stay unless they are linked to one with an identifier.
    """
    return near_duplicates(docs, width=5, percent=80, survivors=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, question and answer."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.filter(F.size("__items") == 0).select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that languages reach their token shares."""
    return mixed(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), TARGETS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the written token store."""
    return tokenized(docs, default_vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_languages),
    ("tokens", write_token_ids),
]
# Fitted models, tokens and components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on ``documents``; what a stage kept is written once for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
