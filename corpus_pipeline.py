"""Corpus pipeline over ``documents``: five training-data operators, each stage's result written and read again.

language ID -> MinHash near-dedup -> PII redaction -> mixing sources -> packing. All stages but the last return the columns
of ``documents``. SQL cannot express the trained stages, so there is no oracle SQL; the stages are tested
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import Scratch, read_table, ship_code
from textloom.llm.language_id import MIN_SCORE, keep_identified
from textloom.llm.mixing import mix_sources
from textloom.llm.near_dedup import drop_near_duplicates
from textloom.llm.packing import ids_crc32, pack
from textloom.llm.pii import redact_pii

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (null or letterless texts, or no language likelier than all others)."""
    ship_code(spark)
    return keep_identified(docs, MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return drop_near_duplicates(docs, Scratch(spark, "pipeline-near"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    ship_code(spark)
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents until all sources weigh the same."""
    return mix_sources(docs).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs all tokens into sequences: one row per piece, its ids digested."""
    return pack(docs, Scratch(spark, "pipeline-pack"), digest=ids_crc32)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before: one row per packed piece.

    Null ids, texts and sources, repeated rows, very long texts and further columns go through every stage as its operator
    says (null and letterless texts leave at the first one); an empty table gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
