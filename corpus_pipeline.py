"""A training-data pipeline: quality, toxicity, near-duplicates, mixture, packing. Counted as part of grovewise.llm.

Each stage takes (spark, docs, sf_dir) and works on the rows that its predecessor kept; classifiers are fitted on the
labels of those rows. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovewise.llm.common import stored, table
from grovewise.llm.minhash import distinct_documents
from grovewise.llm.mixing import mixed_documents
from grovewise.llm.packing import pack_documents
from grovewise.llm.quality import good_documents
from grovewise.llm.tokens import vocabulary_path
from grovewise.llm.toxicity import clean_documents
from grovewise.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more stay."""
    ship(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores 0.5 or more go."""
    ship(spark)
    return clean_documents(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays."""
    ship(spark)
    return distinct_documents(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture of sources by weights 5, 2, 1 takes them."""
    return mixed_documents(docs, weights=(5.0, 2.0, 1.0), limit=3, share=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens."""
    ship(spark)
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"), capacity=4096, closing=2)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
