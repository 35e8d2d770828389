"""A pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept. No text is cut short, and only the
first two stages drop documents: those that the quality rules reject, and all
but one of each group of near-duplicates. The mixing stage repeats documents of
small sources, up to 1.25 times on average, and drops none; the last packs
what there is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mixing, near_dup, packing, quality, queries, scratch, secrets

#: Ids to drop are broadcast up to this many (16 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in shingles of five, similarity 0.8; the document with the smallest id of each group stays, every row without an id stays too.

    An id that occurs with several texts stays, with all of them, if it leads the group of one."""
    found = near_dup.near_duplicates(docs, near_dup.Settings(similarity_pct=80))
    dropped = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)
    kept = found.filter("kept").select("doc_id")
    if kept.count() == kept.distinct().count():
        return left
    apart = left.withColumn("_row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return apart.dropDuplicates(["doc_id", "text", "_row"]).drop("_row")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.Settings(most_repeats=1.25, budget="cover"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, **queries.tokenizer_files()))


STAGES = [("quality_rules", quality_rules), ("minhash_near_dup", drop_near_duplicates), ("secret_scans", mask_secrets), ("source_mixing", mix_sources), ("packing", pack)]

#: Trained trees, components and keyed permutations have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's rows are written to the shared folder and read by the next.

    What a stage wrote on its way, and the rows that it read, are deleted once its own rows are written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch.collecting() as made:
            found = scratch.settle(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        for path in before:
            scratch.drop(spark, path)
        docs, before = found, made
    return docs
