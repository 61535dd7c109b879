"""The corpus pipeline: documents that are identified, good and no copies, mixed to weight and packed.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame that is written and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmill.llm import dart, langid, mixing, packing, quality
from tripmill.llm.common import saved, table
from tripmill.llm.queries import reachable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language is likely, go."""
    reachable(spark)
    return langid.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted good go; learnt from ``labels``."""
    reachable(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    reachable(spark)
    return dart.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    reachable(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    reachable(spark)
    return packing.pack(docs)


STAGES = [
    ("language id", identify_language),
    ("quality classifier", classify_quality),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
