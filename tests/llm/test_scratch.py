import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing, near_dup, scratch, secrets, url_filters


def folders(spark):
    found = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "lodestar"
    return {p.name for p in found.iterdir()} if found.exists() else set()


def test_settled_results_leave_one_table(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g " * (1 + i % 3), "s") for i in range(30)], "doc_id long, text string, source string")
    captures = spark.createDataFrame([(1, "http://x.org/", 5)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("domain:x.org", True, 1)], "address string, listed boolean, at long")
    for run in (lambda: near_dup.near_duplicates(docs), lambda: secrets.scan(docs), lambda: mixing.mix(docs), lambda: url_filters.evaluate(captures, entries)):
        before = folders(spark)
        found = run()
        assert len(folders(spark) - before) == 1 and found.count() >= 1


def test_settle_after_a_failure_and_nested(spark):
    before = folders(spark)

    def fails():
        scratch.table(spark.range(3).toDF("x"), "left")
        raise KeyError("x")

    with pytest.raises(KeyError):
        scratch.settle(fails, "never")
    assert folders(spark) == before
    inner = lambda: scratch.settle(lambda: scratch.table(spark.range(5).toDF("x"), "a").filter("x > 1"), "b")
    found = scratch.settle(lambda: inner().select(F.sum("x").alias("x")), "c")
    assert found.first().x == 9 and len(folders(spark) - before) == 1


class Unset:
    """A session with settings but no folder."""

    conf = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}  # noqa: RUF012
    sparkContext = type("Context", (), {"getConf": staticmethod(dict)})  # noqa: N815


def test_unset_folder_lies_below_the_warehouse(spark):
    assert scratch.shared_dir(Unset) == "hdfs://x/warehouse/_checkpoints"
    assert scratch.shared_dir(spark) == spark.sparkContext.getConf().get(scratch.SETTING).rstrip("/")


def test_tables_go_when_the_application_ends(tmp_path):
    code = """
import sys
from pyspark.sql import SparkSession
from lodestar.llm import scratch
from lodestar.plans import scratch as own
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
for keep in (scratch.table, own.keep):
    assert keep(spark.range(3).toDF("x"), "t").count() == 3
print(len([*__import__("pathlib").Path(sys.argv[1]).rglob("*.parquet")]))
"""
    run = subprocess.run([sys.executable, "-c", code, str(tmp_path / "w")], check=True, capture_output=True, text=True, cwd=pathlib.Path(__file__).parents[2], env=os.environ | {"PYTHONPATH": "."})
    assert int(run.stdout.split()[-1]) >= 2 and not list((tmp_path / "w").rglob("*.parquet"))
