"""The corpus pipeline: five stages over `documents`, each landed as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from catchment.llm.common import land, table

SHARDS = 24
TOXIC = 0.3  # probability from which a document is rejected, as predicted by op6_toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labelled documents outside the held-out fold."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity 0.8)."""
    return jaccard_join.keep_one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rewritten in the order of the mix."""
    return mixing.mix(docs).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot: shards of nearly equal bytes, slots in the order of the mix.

    Rows read from files have no order, so the mix is computed again; it depends on the rows alone.
    """
    placed = sharding.assign_shards(land(mixing.mix(docs)), SHARDS, order_col="mix_position")
    return placed.select(*[c for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot")


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs


#: SQL can't train the network; tests hold every stage against a brute-force version instead.
ORACLE_SQL = None
