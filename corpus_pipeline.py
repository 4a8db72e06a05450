"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing and sharding, each stage over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletypes.llm import decontaminate, minhash, mixing, sharding, toxicity
from tabletypes.plans.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not predicted toxic. A null id, a null text and repeated rows are scored like others."""
    return toxicity.clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), the one with the smallest id.

    Of repeated rows of an id one stays. Rows without an id and texts without words stay.
    """
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    repeats = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = kept.join(repeats, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*kept.columns)).alias("row")).select("row.*")
    return kept.join(repeats, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (a window of the item's size with shingle similarity 0.8). Rows without an id stay."""
    found = decontaminate.matches(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: rates fitted to the domains' target weights, rounded up or down by id."""
    taken = mixing.mixture(docs, _table(spark, sf_dir, "labels")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id").join(taken, "doc_id", "left")
    often = F.coalesce("_copies", F.lit(1))
    return rows.select(F.explode(F.array_repeat("row", often)).alias("row")).select("row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it, in random order."""
    size, _ = sharding.sizes(docs)
    mean = docs.agg(F.avg(size)).first()[0] or 0
    return sharding.shard(docs, row_bytes=int(mean) + sharding.ROW_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", into_shards),
]

ORACLE_SQL = None  # learned scores, minima of hash functions and seeded shuffles; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
