"""A corpus from raw documents to packed sequences: quality, rules, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import exact_substrings, near_dedup, packing, quality_model, quality_rules
from edgeloom.llm.base import saved, table
from edgeloom.session import ship

#: Percent of the union of 5-word shingles that near copies share.
NEAR_COPIES = 80
#: Folds of the labelled ids that the classifier learns from. The rules are proposed and certified on the others, as what the classifier was
#: fitted on and filtered by is no holdout.
CLASSIFIER_FOLDS = (1, 2)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    ship(spark)
    return quality_model.filter_documents(docs, table(spark, sf_dir, "labels"), CLASSIFIER_FOLDS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    return quality_rules.filter_documents(docs, labels.where(~quality_model.fold(labels["doc_id"]).isin(*CLASSIFIER_FOLDS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    ship(spark)
    return near_dedup.filter_documents(docs, NEAR_COPIES)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts; documents of which nothing is left go."""
    ship(spark)
    return exact_substrings.clean_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near-dedup", drop_near_copies), ("suffix-array dedup", drop_repeats), ("best-fit packing", pack)]
#: SQL can express neither the fitted model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
