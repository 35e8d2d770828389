"""Cutting lineage with tables in the folder that the cluster shares.

Everything is written below ``spark.checkpoint.dir``. The setting is read from
the session; where it is unset, as in some tests, a folder below the warehouse
is chosen, which executors share too. An operator with a small result settles
it: the result is written as the last table, and those before it are deleted.
What is left goes when the application ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def _batches_of(spark: SparkSession, most: int | None) -> Iterator[None]:
    before = spark.conf.get(BATCH_BYTES, None)
    if most is not None:
        spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if most is not None and before is None:
            spark.conf.unset(BATCH_BYTES)
        elif most is not None:
            spark.conf.set(BATCH_BYTES, before)


def table(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    A lost executor costs at most the tasks that were running: what was written
    is never computed again. ``batch_bytes`` bounds the Arrow batches that Python
    gets meanwhile, but for a longer row; None leaves the session's bound.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _batches_of(spark, batch_bytes):
        df.write.option("compression", "zstd").parquet(path)
    files, hadoop = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named."""
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that are named meanwhile."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def settle(make: Callable[[], DataFrame], name: str, batch_bytes: int | None = None) -> DataFrame:
    """What ``make`` returns as a table; all that it wrote on the way is deleted, if it fails too."""
    own: list[str] = []
    try:
        with collecting() as own:
            found = make()
        return table(found, name, batch_bytes)
    finally:
        for path in own:
            drop(SparkSession.getActiveSession(), path)


def settled(name: str, batch_bytes: int | None = None) -> Callable:
    """An operator whose result is settled; meant for small results."""

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(*args, **more) -> DataFrame:
            return settle(lambda: operator(*args, **more), name, batch_bytes)

        return run

    return around
