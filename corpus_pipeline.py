"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

``STAGES`` are applied in order; each stage's rows are written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``, whatever further ones there are.

In every stage an empty table gives an empty one, repeated rows are rows of their own, null ids stay null, and texts of
any length count whole.  Null and empty texts are texts without words: both classifiers give them the score of no
evidence, near-dedup takes them for copies of each other, masking leaves them as they are, and packing makes
them a piece of the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phylospan.llm import near_copies, packing, pii, quality, toxicity
from phylospan.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train_from(docs, table(spark, sf_dir, "labels")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_civil(docs, toxicity.train_from(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash tries over 5-word shingles, shingle similarity 0.8 or more."""
    return near_copies.keep_one_of_similar(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask_personal_data(docs, pii.train(pii.sample_texts(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_dedup", keep_distinct),
    ("pii", mask_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers, the tagger and the genetic packing are beyond SQL.
ORACLE_SQL = None
