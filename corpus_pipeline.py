"""Corpus preparation: five stages, each over all that the one before kept.

All stages but the last return rows of documents, with all columns they came with
(clashing names do no harm). Null texts count as empty: equal to each other and to
empty ones, without words, so never contaminated and never near copies of texts
with words; of a group of equal texts one stays, null ids only if all of it have
none. Rows that repeat an id are judged each by its own text; rows equal in id
and text are kept or dropped together by the quality, near-dedup and
decontamination stages, and one stays in exact dedup. Texts of any length are read
whole. Ties are broken by id, then by hash. An empty table gives an empty table in
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickfold.llm import bpe, exact_dedup, inverted, resample, simhash
from tickfold.llm.common import read_table, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    return resample.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies."""
    return simhash.keep_one_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return inverted.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.bpe_digests(docs, bpe.vocabulary_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", encode)]
#: Hash models, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
