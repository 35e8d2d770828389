import pytest
from pyspark.sql import functions as F

from lodestar.plans import catalog, search
from lodestar.plans.catalog import Store
from lodestar.plans.config import Limits
from lodestar.streaming.ingest import event_windows, ingest_stream

DOC = "id string, uri string, title string, metadata string"
CHUNK = "document_id string, ordinal long, content string, embedding array<float>"


def test_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.stats() == {"document_count": 0, "chunk_count": 0}
    docs = spark.createDataFrame([("tides", "", "Sea", "{}"), ("rocks", "", "x", "{}")], DOC)
    chunks = spark.createDataFrame([("tides", i, t, [0.25 * i, 1.0]) for i, t in enumerate(["ebb and flow", "spring tide", "moon"])] + [("rocks", 0, "basalt", [0.0, 2.0])], CHUNK)
    assert store.ingest(docs, chunks) == {"documents": 2, "chunks": 4, "skipped": 0}
    before = store.version
    assert store.ingest(docs, chunks) == {"documents": 0, "chunks": 0, "skipped": 2} and store.version == before
    assert store.ingest(docs, chunks.filter("ordinal < 2")) == {"documents": 1, "chunks": 2, "skipped": 1}
    assert [r.id for r in store.chunks_of("tides").collect()] == ["tides#0", "tides#1"]
    assert store.get_document("tides").first().chunk_count == 2
    assert store.upsert_chunks(chunks.filter("ordinal = 2")) == 1
    assert store.ingest(docs, chunks.filter("ordinal < 2"))["documents"] == 1
    assert [r.id for r in store.list_documents(1, 1).collect()] == ["tides"]
    assert store.delete_document("tides") == {"documents_deleted": 1, "chunks_deleted": 2}
    assert store.stats() == {"document_count": 1, "chunk_count": 1} and store.delete_document("tides")["chunks_deleted"] == 0


def test_graph_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    new = spark.createDataFrame([("Ems", "river", ["long", "calm"]), ("Emden", "port", []), ("Ferry", "ship", ["white"])], "name string, entity_type string, observations array<string>")
    assert store.create_entities(new) == 3 and store.read("observation").count() == 3
    with pytest.raises(ValueError):
        store.create_entities(new.limit(1))
    edges = spark.createDataFrame([("Ems", "reaches", "Emden")], "from_entity string, relation_type string, to_entity string")
    assert store.create_relations(edges) == 1
    with pytest.raises(ValueError):
        store.create_relations(edges)
    assert store.add_observations("Emden", ["new"]) == 1 and store.add_observations("Emden", []) == 0
    assert {r.name: r.observations for r in store.entities().collect()} == {"Ems": ["calm", "long"], "Emden": ["new"], "Ferry": ["white"]}
    assert store.delete_observations("Ems", ["long", "zzz"]) == 1
    assert store.delete_entities(["Ems", "nobody"]) == 1 and store.read("relation").count() == 1
    assert store.delete_relation("Ems", "reaches", "Emden") == 1 and store.delete_relation("Ems", "reaches", "Emden") == 0
    vec = spark.createDataFrame([("v1", "Emden", "t", [0.5]), ("v2", "Emden", "t", [0.1])], "id string, entity_name string, text_content string, embedding array<float>")
    assert store.upsert_vectors(vec) == 2 and store.upsert_vectors(vec) == 2 and store.read("vector").count() == 2
    assert store.delete_vectors(id="v1") == 1 and store.delete_vectors(entity_name="Emden") == 1
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "s"), Limits(restricted=True)).create_entities(new)


def test_streams(spark, tmp_path):
    store, where = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = DOC + ", text string"
    spark.createDataFrame([("a", "u", "t", "{}", "one two three"), ("b", "u", "t", "{}", "")], schema).write.parquet(where)
    for n in range(2):
        ingest_stream(spark.readStream.schema(schema).parquet(where), store, str(tmp_path / f"c{n}"), 2, 0).awaitTermination()
    assert store.stats() == {"document_count": 2, "chunk_count": 2}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:00:00", "x", 4.0)], "ts string, event_type string, value double")
    assert sorted(r.total for r in event_windows(events.withColumn("ts", F.to_timestamp("ts"))).collect()) == [3.0, 4.0]


def test_ids_are_unique(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("a", "", "1", ""), ("a", "", "2", "")], DOC)
    chunks = spark.createDataFrame([("a", 0, "x", [1.0])], CHUNK)
    for write in (lambda: store.ingest(docs, chunks), lambda: store.ingest(docs.limit(1), chunks.union(chunks)), lambda: store.upsert_chunks(chunks.union(chunks))):
        with pytest.raises(ValueError):
            write()
    vec = spark.createDataFrame([("v", "e", "t", [0.5])] * 2, "id string, entity_name string, text_content string, embedding array<float>")
    with pytest.raises(ValueError):
        store.upsert_vectors(vec)
    assert store.version == 0


def test_steps_versions_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_STEPS", 5)
    store, told = Store(spark, str(tmp_path / "s")), set()
    for i in range(9):
        store.add_observations(f"e{i % 3}", [f"o{i}"])
        told.add((f"e{i % 3}", f"o{i}"))
        if i % 4 == 3:
            assert store.delete_observations(f"e{i % 3}", [f"o{i}"]) == 1
            told.discard((f"e{i % 3}", f"o{i}"))
        assert {(r.entity_name, r.content) for r in store.read("observation").collect()} == told
    store.add_observations("e0", ["o3"])
    assert ("e0", "o3") in {(r.entity_name, r.content) for r in store.read("observation").collect()}
    assert store.version == 12 and store.read("observation", 2).count() == 2
    before = len(list((tmp_path / "s/data").iterdir()))
    assert 0 < store.vacuum() < before and store.read("observation").count() == len(told) + 1
    assert len(list((tmp_path / "s/versions").glob("*.json"))) == 1 and store.version == 12
    assert store.has_observations("e1") and not store.has_observations("nobody") and store.counts()["observation"] == len(told) + 1


def test_a_write_costs_what_it_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create_entities(spark.range(500).selectExpr("concat('n', id) name", "'t' entity_type", "array('o') observations"))
    old = set((tmp_path / "s/data").iterdir())
    store.add_observations("n1", ["new"])
    rows = [spark.read.parquet(str(p)).count() for p in set((tmp_path / "s/data").iterdir()) - old]
    assert rows == [1] and store.read("observation").count() == 501


def test_cascade_is_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create_entities(spark.createDataFrame([("A", "t", ["x"]), ("B", "t", ["y"])], "name string, entity_type string, observations array<string>"))
    store.create_relations(spark.createDataFrame([("A", "r", "B"), ("B", "r", "B")], "from_entity string, relation_type string, to_entity string"))
    store.upsert_vectors(spark.createDataFrame([("v", "A", "t", [0.5]), ("w", "B", "t", [0.5])], "id string, entity_name string, text_content string, embedding array<float>"))
    version = store.version
    assert store.delete_entities(["A"], cascade=True) == 1 and store.version == version + 1
    assert store.counts() == {"document": 0, "chunk": 0, "entity": 1, "observation": 1, "relation": 1, "vector": 1}
    assert [r.id for r in store.vectors_of("B").collect()] == ["w"]


def test_two_writers(spark, tmp_path):
    one = Store(spark, str(tmp_path / "s"))
    one.add_observations("a", ["x"])
    late = type("Late", (Store,), {"version": property(lambda self: 0)})(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError):
        late.add_observations("a", ["y"])
    assert [r.content for r in one.read("observation").collect()] == ["x"]


def test_stream_of_one_id_twice(spark, tmp_path):
    store, where, schema = Store(spark, str(tmp_path / "s")), str(tmp_path / "in"), DOC + ", text string"
    spark.createDataFrame([("a", "u", "old", "{}", "x"), ("a", "u", "young", "{}", "one two three"), ("a", "u", "new", "{}", "y")], schema).repartition(3).write.parquet(where)
    ingest_stream(spark.readStream.schema(schema).parquet(where), store, str(tmp_path / "c"), 2, 0).awaitTermination()
    assert store.get_document("a").first().title == "young" and store.stats() == {"document_count": 1, "chunk_count": 2}


def test_searcher(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.range(20).selectExpr("concat('d', id) id", "'' uri", "'' title", "'{}' metadata")
    chunks = spark.range(400).selectExpr("concat('d', id % 20) document_id", "id div 20 ordinal", "concat('word', id) content", "array(float(id), float(id * id % 37)) embedding")
    store.ingest(docs, chunks)
    searcher = search.Searcher(store, index_from=100, cells=8, probes=8)
    shown = lambda df: [tuple(r) for r in df.collect()]
    exact = shown(searcher.vector_search([100.0, 10.0], 5, exact=True))
    assert shown(searcher.vector_search([100.0, 10.0], 5)) == exact
    assert len(list((tmp_path / "s/index").iterdir())) == 1 and searcher.index() is searcher.index()
    monkeypatch.setattr(search.ann, "build", None)
    assert search.Searcher(store, index_from=100).vector_search([1.0, 1.0], 3).count() == 3
    hits, get = [], searcher.cache.get
    monkeypatch.setattr(searcher.cache, "get", lambda *a: hits.append(get(*a)) or hits[-1])
    assert shown(searcher.vector_search([200.0, 20.0], 5)) == exact
    assert searcher.vector_search([100.0, 10.0], 4).count() == 4 and searcher.hybrid_search([100.0, 10.0], "word7", 3).count() == 3
    assert [h is not None for h in hits] == [True, False, False]
    assert {r.document_id for r in searcher.vector_search([5.0, 5.0], 5, document="d3").collect()} == {"d3"}
    monkeypatch.undo()
    store.delete_document("d0")
    left = searcher.vector_search([100.0, 10.0], 5).collect()
    assert "d0" not in {r.document_id for r in left} and [tuple(r) for r in left] != exact
