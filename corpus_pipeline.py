"""From raw documents to training shards, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's docs.  All but the last keep the columns of the
documents table, the last one beside its own.  NULL and empty texts fail the first stage;
empty tables pass through as such; repeated rows are judged alike and stay one document
after the second stage, and the last one repeats rows as the mix does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenpeak.functions.shared import written
from lumenpeak.llm import decontam, mixing, quality, sharding, simhash
from lumenpeak.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the current policy of quality rules."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked fingerprints."""
    return simhash.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources reach their targets."""
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal every document, repeats too, with its text and source into shards of equal size."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", mixed_sources),
    ("sharding", shards),
]
# Fingerprints and drawn shards have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
