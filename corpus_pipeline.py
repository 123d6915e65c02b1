"""A corpus pipeline: good documents, one of each near-duplicate group, without personal data, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last one returns sampled encodings.  `run` writes what a stage returns as Parquet to the shared folder and reads it again.

Odd rows: see the operators.  Null texts count as empty: they stay where the quality prior is over the cut, are nobody's
duplicate, and the mix does not take them (size 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import minhash, mixing, pii, quality, segmentation
from cohortloom.session import stage

ORACLE_SQL = None  # compression, sampling and lattices are beyond SQL
PERCENT = 80  # likeness of near duplicates here


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return minhash.one_of_each(docs, PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and revealing terms generalised or removed."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text."""
    return segmentation.segment(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("personal data", without_personal_data),
    ("source mix", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = stage(f(spark, docs, sf_dir))
    return docs
