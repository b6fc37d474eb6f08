"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, token ids.

Every stage works on all that its predecessor kept, and its result is written to the shared folder and read again; tables
that are no longer needed are deleted. Rows that share an id are told apart by their texts: near-duplicates keep one row
of each group, equal rows being one group; contaminated texts go wherever they stand. Other columns may have any names;
the last stage replaces columns named like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import beside, delete, read_table, settled
from attestra.llm.decontaminate import decontaminate
from attestra.llm.line_dedup import dedup_lines
from attestra.llm.quality import judge
from attestra.llm.sentencepiece_codec import model_bytes, round_trip
from attestra.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return beside(docs, ("doc_id", "text"), lambda d: judge(d, read_table(spark, sf_dir, "labels")).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated lines; one that has no word left by that goes. n_chars follows the text."""
    out = beside(docs, ("doc_id", "text"), lambda d: dedup_lines(d).where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \t-\r]")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens, and whether decoding gives the text back."""
    tokens = lambda d: round_trip(d, model_bytes()).withColumn("n_tokens", F.size("token_ids").cast("long"))
    return beside(docs, ("doc_id", "text"), tokens, ("token_ids", "n_tokens", "restored"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither the hash of the quality rules and fingerprints nor the segmentation; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if last:
            delete(spark, last)
        last = path
    return docs
