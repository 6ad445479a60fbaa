"""A training-data pipeline over ``documents``: five stages, each written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, exact_dedup, minhash, mixing, quality
from foliant.llm.queries import vocabulary
from foliant.runtime import compacted, drop_scratch, materialize, scratch_mark, ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones."""
    ship(spark)
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return compacted(quality.score(docs, forest, "__score").where("__score >= 0.5").select(*docs.columns), docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarities of 0.8 or more of their five-word shingles link, one document."""
    ship(spark)
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources by weight takes its words."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, and digest of the text they decode to."""
    ship(spark)
    return compacted(bpe.digests(docs, vocabulary()), docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_equal),
    ("minhash_near_dedup", one_of_similar),
    ("mixing_sources", weighted_sources),
    ("bpe_encoding", token_ids),
]

#: Trees, signatures and merges aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        mark = scratch_mark()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            drop_scratch(mark, keep=1)  # the stage's own tables; what it returned stays
    return docs
