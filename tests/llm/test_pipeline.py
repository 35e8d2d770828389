import os
import pathlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_near_dup import brute as groups
from test_packing import plain_ids
from test_quality import brute as counts
from test_secrets import brute as secret_spans

import corpus_pipeline
from lodestar.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


def masked(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secret_spans(text)[-1].split(",") if s)
    out, at = "", 0
    for start, end in spans:
        if start > at or not out:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:] if spans else text


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    first, second, third, fourth, fifth = (f for _, f in corpus_pipeline.STAGES)

    good = first(spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.schema == docs.schema and kept == {i for i, r in judged.items() if r.kept}
    assert not any(counts(rows[i].text)[-1] for i in kept)

    good = good.cache()
    alone = second(spark, good, SF)
    assert alone.columns == docs.columns
    left = {r.doc_id for r in alone.collect()}
    assert left == {i for i, _, _, keep in groups([(i, rows[i].text) for i in kept], 80) if keep}

    clean = third(spark, alone, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {i: masked(rows[i].text) for i in left}
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    clean = clean.cache()
    mixed = fourth(spark, clean, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    planned = mixing.plan(clean, mixing.Settings(most_repeats=1.25, budget="cover")).select(F.col("row.doc_id"), "epochs").collect()
    assert times == {r.doc_id: r.epochs for r in planned} and set(times) == left

    pieces = fifth(spark, mixed, SF).collect()
    assert sum(p.length for p in pieces) == sum(n * len(plain_ids(texts[i])) for i, n in times.items())
    assert {p.doc_id for p in pieces} == left


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, two), (5, one), (5, two), (9, one), (9, one), (None, one)], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(map(tuple, left.collect()), key=str) == [(3, two), (5, one), (5, two), (None, one)]


def test_near_duplicates_without_ids_all_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    for more in ([], [(4, two), (4, two)]):
        docs = spark.createDataFrame([(None, one), (None, one), (None, None), (None, None), (9, one), *more], "doc_id long, text string")
        left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect()), key=str) == sorted([(None, one), (None, one), (None, None), (None, None), (9, one), *more[:1]], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_run_over_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_one_table(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "lodestar"
    before = set(shared.iterdir()) if shared.exists() else set()
    found = corpus_pipeline.run(spark, SF)
    assert len(set(shared.iterdir()) - before) == 1 and found.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected
