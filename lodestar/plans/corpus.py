"""The test tables seen as the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.chunking import chunk_window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores if the table is read by far fewer tasks, as a small table of one row group is; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores // 2 else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, uri, title, metadata, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("uri"), F.col("lang").alias("title"), F.concat(F.lit('{"n_chars":'), F.col("n_chars").cast("string"), F.lit("}")).alias("metadata"), "text")


def chunks(spark: SparkSession, sf_dir: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """id, document_id, ordinal, content, token_count, doc_id."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    cut = chunk_window(docs, "doc_id", "text", size, overlap)
    return cut.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("document_id"), "ordinal", "content", "token_count", "doc_id")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vector whose id is (31 * document + ordinal) modulo the number of vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    own = chunks(spark, sf_dir).withColumn("vec_id", F.pmod(F.col("doc_id") * 31 + F.col("ordinal"), F.lit(max(1, n))))
    return own.join(vectors, "vec_id").drop("vec_id", "doc_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, entity_type, observations."""
    parts = [
        ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_mktsegment"),
        ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_brand"), ("orders", "o_orderkey", "o_orderstatus"),
    ]
    out = None
    for name, key, told in parts:
        kind = "order" if name == "orders" else name
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("entity_type"), F.array(told).alias("observations"))
        out = own if out is None else out.union(own)
    return out


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select(F.col("name").alias("entity_name"), F.explode("observations").alias("content"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_entity, relation_type, to_entity."""
    tagged = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    row = lambda df, a, kind, b: df.select(tagged(*a).alias("from_entity"), F.lit(kind).alias("relation_type"), tagged(*b).alias("to_entity"))
    lines = table(spark, sf_dir, "lineitem")
    return (
        row(table(spark, sf_dir, "nation"), ("nation", "n_nationkey"), "in_region", ("region", "n_regionkey"))
        .union(row(table(spark, sf_dir, "customer"), ("customer", "c_custkey"), "in_nation", ("nation", "c_nationkey")))
        .union(row(table(spark, sf_dir, "supplier"), ("supplier", "s_suppkey"), "in_nation", ("nation", "s_nationkey")))
        .union(row(table(spark, sf_dir, "orders"), ("order", "o_orderkey"), "placed_by", ("customer", "o_custkey")))
        .union(row(lines.select("l_orderkey", "l_partkey").distinct(), ("order", "l_orderkey"), "contains", ("part", "l_partkey")))
        .union(row(lines.select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), "supplied_by", ("supplier", "l_suppkey")))
    )
