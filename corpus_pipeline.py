"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tracelake.llm.common import table
from tracelake.llm.queries import tokenizer_path
from tracelake.registry import query
from tracelake.session import persist_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of the documents with equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, threshold=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: A learned classifier and a tokenizer take part, which SQL cannot express; the tests hold run() against plain Python.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = persist_table(stage(spark, rows, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return rows
