"""The corpus pipeline: five stages over documents, each written and read again by the next one.

Each stage works on all rows that its predecessor kept; all but the last return the columns of
documents.  The mix repeats a row as many times as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import dedup, gam, jaccard, mixing, pieces
from copse.llm.common import quoted, stored
from copse.llm.queries import PIECES

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
#: Near copies: sets of so many words a shingle with a Jaccard similarity of so many hundredths or more.
NEAR_WORDS, NEAR_LINK = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.scores(F.col("text")) >= LEAST_QUALITY).select(*map(quoted, docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.one_per_component(docs, k=NEAR_WORDS, link=NEAR_LINK)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return pieces.tokenized(docs, PIECES)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL expresses neither the classifier nor the draws of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
