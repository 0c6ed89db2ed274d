"""From raw documents to packed training sequences.

Each stage takes what the stage before it kept, written as Parquet and read again. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import exact_dedup, minhash, quality, toxicity
from pagemill.llm._shared import cleared, delete, shared_folder, table
from pagemill.llm.queries import packed_documents


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_toxicity(toxicity.labelled_for_training(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good_texts(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("packing", packed),
]

#: The classifier and the outlier estimates are fitted, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again; what a stage needed goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name.replace(' ', '_')}")
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(f"{folder}/{name.replace(' ', '_')}"), folder
    return STAGES[-1][1](spark, docs, sf_dir)
