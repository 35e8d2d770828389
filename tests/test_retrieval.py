import os

import numpy as np
import pytest

from lodestar.operators import ann, retrieval
from lodestar.plans.config import Limits
from lodestar.queries import QUERIES


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{i}", "docA" if i < 4 else "docB", i, f"chunk {'x' * (i % 5)} Word{i}", [0.02 * i] * 8) for i in range(50)]
    return spark.createDataFrame([*rows, ("null", "docB", 50, "chunk", None), ("short", "docB", 51, None, [1.0])], "id string, document_id string, ordinal int, content string, embedding array<float>").cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_vector_search(chunks):
    found = ids(retrieval.vector_search(chunks, [0.5] * 8, 3))
    assert found[0] == "c25" and set(found[1:]) == {"c24", "c26"}
    assert set(ids(retrieval.vector_search(chunks, [0.5] * 8, 9, document="docA"))) == {"c0", "c1", "c2", "c3"}
    assert len(ids(retrieval.vector_search(chunks, [0.5] * 8, 9, limits=Limits(max_k=2)))) == 2
    assert ids(retrieval.nearest(chunks, [0.5] * 8, 0)) == [] == ids(retrieval.nearest(chunks, [float("nan")] * 8, 3, "cosine"))[3:]


def test_lexical(chunks):
    assert ids(retrieval.lexical_search(chunks, "wORD4", 3)) == ["c40", "c45", "c41"]
    rows = retrieval.lexical_search(chunks, "WORD", 50).collect()
    assert [len(r.content) for r in rows] == sorted(len(r.content) for r in rows) and len(rows) == 50


def test_rrf(spark):
    lists = [spark.createDataFrame(list(zip(names, range(1, 9), strict=False)), "id string, rank int") for names in ("pqr", "sq")]
    rows = retrieval.reciprocal_rank_fusion(lists).collect()
    assert [r.id for r in rows] == ["q", "p", "s", "r"]
    assert rows[0].score == pytest.approx(2 / 62) and rows[3].score == pytest.approx(1 / 63)


def test_mmr(spark):
    e = np.array([[0.0, 3], [2, 0], [-1, 1], [0, 1]])
    assert retrieval.mmr_order(np.array([0.4, 0.1, 0.3, 0.8]), e, 4, 1.0) == [3, 0, 2, 1]
    assert retrieval.mmr_order(np.array([0.4, 0.1, 0.3, 0.8]), e, 3, 0.0) == [0, 1, 2]
    df = spark.createDataFrame([("a", 0.2, [1.0, 0.0]), ("b", 0.9, [0.0, 1.0]), ("c", 0.5, [1.0, 1.0])], "id string, score double, embedding array<float>")
    assert [r.id for r in retrieval.mmr(df, 2, 1.0).orderBy("position").collect()] == ["b", "c"]


def test_hybrid(chunks):
    rows = retrieval.hybrid_search(chunks, [0.5] * 8, "word25", 5).collect()
    assert rows[0].id == "c25" and [r.position for r in rows] == [1, 2, 3, 4, 5]
    assert len(retrieval.hybrid_search(chunks, [0.5] * 8, "word", 5, use_mmr=True).collect()) == 5
    assert [r.id for r in retrieval.hybrid_search(chunks, None, "word7", 5).collect()] == ["c7"]
    assert retrieval.hybrid_search(chunks, None, "nowhere", 5).collect() == []
    with pytest.raises(ValueError):
        retrieval.hybrid_search(chunks, None, "")


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>").cache()
    index = ann.build(df, cells=8)
    asked = rng.normal(size=(12, 4))
    hits = 0
    for q in asked:
        exact = set(np.argsort(((x - q) ** 2).sum(1))[:10])
        hits += len(exact & {int(i) for i in ids(ann.search(index, q.tolist(), 10, probes=5))})
    assert hits / 120 >= 0.9
    assert ids(ann.search(index, asked[0].tolist(), 10, probes=8)) == [f"{i:03}" for i in np.argsort(((x - asked[0]) ** 2).sum(1))[:10]]
    queries = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(asked)], "query_id int, query_vector array<double>")
    rows = retrieval.batch_nearest(df, queries, 5, "euclidean", block=5).collect()
    for k, q in enumerate(asked):
        assert [r.id for r in sorted((r for r in rows if r.query_id == k), key=lambda r: r.rank)] == [f"{i:03}" for i in np.argsort(((x - q) ** 2).sum(1))[:5]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ivf_on_the_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    x, names = np.array([r.embedding for r in rows], dtype=float), np.array([str(r.vec_id) for r in rows])
    got = {}
    for r in sorted(QUERIES["ivf_topk"](spark, path).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    asked = [i for i, r in enumerate(rows) if r.vec_id % 50 == 0]
    assert set(got) == {names[i] for i in asked}
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert got[names[i]] == [names[j] for j in np.lexsort((names, d))[:10]]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_ivf_batch_far_cells_and_ties(spark, metric):
    x = np.repeat(np.random.default_rng(1).normal(size=(40, 3)), 3, axis=0) + 50 * (np.arange(120)[:, None] % 4 == 0)
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", [])], "id string, embedding array<double>")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(9)], "query_id int, query_vector array<double>")
    rows = ann.search_batch(ann.build(df, cells=6, metric=metric), queries, 7, probes=1).collect()
    for k in range(9):
        u = x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x
        d = ((u - u[k]) ** 2).sum(1)
        assert [r.id for r in sorted((r for r in rows if r.query_id == k), key=lambda r: r["rank"])] == [f"{i:03}" for i in np.argsort(d, kind="stable")[:7]]
    assert ann.search_batch(ann.build(df, cells=6), queries.limit(0)).collect() == []


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_binary_rerank_exact(spark, metric):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    df = spark.read.parquet(path).selectExpr("cast(vec_id as string) as id", "embedding").cache()
    rows = df.collect()
    x, names = np.array([r.embedding for r in rows], dtype=float), np.array([r.id for r in rows])
    u = x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x
    for i in [j for j, r in enumerate(rows) if int(r.id) % 500 == 0]:
        best = names[np.lexsort((names, ((u - u[i]) ** 2).sum(1)))[:10]].tolist()
        assert ids(ann.binary_rerank(df, x[i].tolist(), metric=metric, exact=True)) == best
    near = spark.createDataFrame([(f"{i}", [1.0, 0.01 * i]) for i in range(-5, 6)] + [("far", [-1.0, -1.0])], "id string, embedding array<double>")
    assert ids(ann.binary_rerank(near, [1.0, 0.001], 3, factor=1, metric=metric, exact=True)) == ["0", "1", "-1"]


def test_batch_ties_lengths_and_many_batches(spark):
    rows = [(str(i), [1.0, 2.0]) for i in range(9, -1, -1)] + [("x", [1.0]), ("y", [1.0, 2.0, 3.0]), ("z", None), ("w", [float("nan"), 1.0]), ("v", [0.0, 0.0])]
    table = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0]), (3, None), (4, [0.0, 0.0])], "query_id int, query_vector array<double>")
    for metric in ("cosine", "euclidean"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = {}
        for r in sorted(retrieval.batch_nearest(table, asked, 3, metric).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.id)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got[1] == ["0", "1", "2"] and got[2] == ["x"] and 3 not in got
        assert got[4] == (["0", "1", "2"] if metric == "cosine" else ["v", "0", "1"])
    with pytest.raises(ValueError):
        retrieval.batch_nearest(table, asked, 3, most_queries=1)


def test_hydration_moves_found_rows_only(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as string) id", "'d' document_id", "id ordinal", "repeat('x', 100) content", "array(double(id), 1D) embedding").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    found = retrieval.vector_search(chunks, [3.0, 1.0], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters: [In(id, [2,3]" in plan.replace("[3,2]", "[2,3]")
    assert ids(found) == ["3", "2"]
    gone = spark.createDataFrame([("3", 0.5), ("gone", 0.1)], "id string, distance double")
    assert {(r.id, r.ordinal) for r in retrieval.hydrate(gone, chunks, ["ordinal"]).collect()} == {("3", 3), ("gone", None)}


def test_distance_is_computed_once(chunks):
    plan = retrieval.nearest(chunks, [0.5] * 8, 3)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("zip_with") + plan.count("zipwith") == 1
    found = retrieval.nearest(chunks, [0.5] * 8, 100, "cosine").collect()
    assert len(found) == 50 and [r.distance for r in found] == sorted(r.distance for r in found)


def test_trace(chunks):
    lines = []
    trace = retrieval.Trace(lines.append)
    rows = retrieval.hybrid_search(chunks, [0.5] * 8, "word", 5, use_mmr=True, trace=trace).collect()
    assert [s["stage"] for s in trace.stages] == ["vector", "lexical", "fuse", "rerank"] and trace.stages[3]["count"] == 5 == len(rows)
    assert lines == trace.lines() and lines[0].startswith("stage=vector us=") and lines[0].endswith("count=30")


def test_index_reads_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))] + [("bad", [float("nan")] * 4)], "id string, embedding array<double>")
    ann.build(df, cells=8, path=str(tmp_path / "i"))
    index = ann.load(spark, str(tmp_path / "i"), df.schema)
    plan = ann.search(index, [0.1] * 4, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and len(ann.search(index, [0.1] * 4, 5, probes=2).collect()) == 5
    assert index.celled.count() == 200
    empty = ann.build(df.limit(0))
    assert ann.search(empty, [0.0] * 4).collect() == []
