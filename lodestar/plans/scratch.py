"""Tables in the shared folder ``spark.checkpoint.dir``, to cut lineage between rounds of an iteration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder; where the setting is absent, one below the warehouse, which executors share too."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder; like all that is kept here, it goes when the application ends."""
    path = f"{folder(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    files, hadoop = _file_system(spark, path)
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    path = f"{new_path(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named, once nothing reads it any more."""
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)
