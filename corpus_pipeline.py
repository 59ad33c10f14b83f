"""From documents to training shards: quality, near-duplicates, decontamination, mixing, sharding.

Each stage works on all that its predecessor kept, as a table written and read again. All stages
but the last return the columns of documents; the last adds shard and slot. Rows without doc_id
pass every stage that doesn't find a fault in their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.llm import decontam, mixing, quality, sharding
from strataspark.llm.near_dedup import NearDuplicates
from strataspark.runtime import importable
from strataspark.storage import Workspace

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at least 0.7."""
    labels = importable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked on five-word shingles at 80 per cent."""
    found = NearDuplicates(words=5, percent=80).run(docs)
    dropped = found.where("not kept").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    # rows that repeat an id are one document: the first by its text stays
    first = Window.partitionBy("doc_id").orderBy(F.length("text"), F.xxhash64("text"))
    number = "_row"
    while number in docs.columns:
        number = f"_{number}"
    numbered = kept.withColumn(number, F.row_number().over(first))
    return numbered.where((F.col(number) == 1) | F.col("doc_id").isNull()).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh as the square root of their masses."""
    return mixing.mix_sources(docs, alpha=0.5, seed=8)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards of equal counts, uniformly shuffled."""
    return sharding.shard_rows(docs, SHARDS, seed=5)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier, the components and the edit distances have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(importable(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
