"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import released, stored, table
from quern.llm.mixing import mixed_documents
from quern.llm.ngram_join import one_of_each
from quern.llm.quality import kept_documents
from quern.llm.tokens import default_path
from quern.llm.toxicity import clean_documents
from quern.llm.word_bpe import word_bpe_digests

#: Sources' weights in turn, the share of all words that they take, and the most copies of a document.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of toxic texts does not reject."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by votes among the documents that are left."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its distinct runs of five words."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixed_documents(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return word_bpe_digests(docs, default_path("word_bpe_49k.json"))


def _alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun without the memory that the one before has grown into."""

    @wraps(stage)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark)
        return stage(spark, docs, sf_dir)

    return run_alone


STAGES = [(f.__name__, _alone(f)) for f in (toxicity, quality, near_duplicates, mixing, encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
