import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from lodestar import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries.QUERIES) > 40


def test_without_the_subpackage():
    code = "import sys; sys.modules['lodestar.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_without_the_folders(tmp_path):
    """A copy from which the subpackage, its tests and the pipeline are deleted: it imports, runs a query and its other tests are found."""
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, copy := tmp_path / "copy", ignore=left_out)
    assert not (copy / "lodestar/llm").exists() and not (copy / "tests/llm").exists()
    code = "import __spark_entry__ as e; from lodestar.session import session; print(len(e.queries()), e.entry(session('local[2]')).count() if %r else 10)" % os.path.exists(SF)
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=copy, check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}).stdout
    n, rows = run("-c", code).split()[-2:]
    assert int(n) > 80 and int(rows) == 10
    assert "test_catalog" in (found := run("-m", "pytest", "tests", "--collect-only", "-q")) and "llm" not in found


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["vector_topk_l2", "chunk_window", "rrf_hybrid", "bfs_distance", "neighbors_both", "json_to_text", "fulltext", "hybrid_mmr", "store_ingest", "store_relations", "stored_search", "pdf_to_text", "parquet_bytes_to_text"])
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(str, cursor.fetchall()))
