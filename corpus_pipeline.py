"""A corpus pipeline of five stages, each of which reads what the one before it kept.

Quality rules and near-duplicates drop documents, line dedup drops lines, decontamination drops documents with a copy of
a test item, and the last stage tells how many words of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, mixing, near_dup, quality
from tidemark.llm.common import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars is that of the text as it is now."""
    return line_dedup.drop_repeated_lines(docs).select(docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized, pieces = mixing.mix(docs)
    return mixing.taken(sized, pieces).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


#: (name, function of spark, docs and sf_dir)
STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs


#: The estimates of the first stage and the forest of the third have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
