"""Corpus pipeline: quality rules, toxicity, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediastrata.llm import packing, quality, simhash, toxicity
from mediastrata.llm.common import drop, materialized, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and stand on a host that does."""
    return quality.filter_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model is fitted on the labelled ones among them."""
    return toxicity.filter_documents(docs, toxicity.fit(spark, docs, sf_dir))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document's tokens, with its place in a sequence."""
    return packing.production_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: No SQL form: the later stages train a model and run a tokenizer. A test holds run() against the stages written out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next, after which the one before is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = materialized(docs, f"pipeline-{name}")
            if before:
                drop(spark, before)
            before = path
    return docs
