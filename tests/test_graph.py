import pytest

from lodestar.operators import graph


@pytest.fixture(scope="module")
def tables(spark):
    entities = spark.createDataFrame([(f"e{i}", "type_a" if i < 5 else "type_b", [f"note {i}"] if i % 2 else []) for i in range(10)], "name string, entity_type string, observations array<string>")
    edges = [(f"e{i}", "knows", f"e{i + 1}") for i in range(9)] + [("e0", "knows", "e2"), ("e3", "likes", "e3"), ("e9", "knows", "ghost")]
    return entities, spark.createDataFrame(edges, "from_entity string, relation_type string, to_entity string")


def test_stats(tables):
    entities, relations = tables
    assert [tuple(r) for r in graph.entity_stats(entities).collect()] == [("type_a", 5), ("type_b", 5)]
    assert [tuple(r) for r in graph.relation_stats(relations).collect()] == [("knows", 11), ("likes", 1)]
    assert tuple(graph.graph_stats(entities, relations).first()) == (10, 12)
    assert [graph.degree(relations, "e3", w).first().degree for w in ("out", "in", "both")] == [2, 2, 4]
    assert {r.name: r.degree for r in graph.degrees(relations).collect()}["e3"] == 4


def test_pages(tables):
    entities, relations = tables
    own, near = graph.read_graph(entities, relations, "type_b", 2, 1)
    assert [r.name for r in own.collect()] == ["e6", "e7"] and near.count() == 3
    own, _ = graph.search_nodes(entities, relations, "TYPE_A", offset=3)
    assert [r.name for r in own.collect()] == ["e3", "e4"]
    own, near = graph.open_nodes(entities, relations, ["e5", "ghost", "e1", "e5"])
    assert [r.name for r in own.collect()] == ["e5", "e1", "e5"] and near.count() == 5
    assert [r.to_entity for r in graph.search_relations(relations, from_entity="e0").collect()] == ["e1", "e2"]


def test_neighbours(tables):
    names = lambda way: sorted(r.name for r in graph.neighbors(*tables, ["e3"], way)[0].collect())
    assert names("out") == ["e3", "e4"] and names("in") == ["e2", "e3"] and names("both") == ["e2", "e3", "e4"]
    assert graph.neighbors(*tables, [], "both")[1].count() == 0
    assert [graph.direction(x) for x in ("OUTGOING", "in", None, "x")] == ["out", "in", "both", "both"]


def test_paths(tables):
    _, relations = tables
    assert graph.shortest_path(relations, "e0", "e5", 5, "out") == ["e0", "e2", "e3", "e4", "e5"]
    assert graph.shortest_path(relations, "e5", "e0", 10, "in") == ["e5", "e4", "e3", "e2", "e0"]
    assert graph.shortest_path(relations, "e5", "e0", 10, "out") == [] == graph.shortest_path(relations, "e0", "e9", 3)
    assert graph.shortest_path(relations, "e0", "e0") == [] and graph.shortest_path(relations, "e0", "e0", allow_same=True) == ["e0"]


def test_fulltext(spark, tables):
    entities, _ = tables
    told = spark.createDataFrame([("e4", "secret garden"), ("gone", "garden")], "entity_name string, content string")
    assert [r.name for r in graph.fulltext(entities, told, "GARDEN").collect()] == ["e4"]
    assert [r.name for r in graph.fulltext(entities, told, "note", 2).collect()] == ["e1", "e3"]


def test_adjacency(spark, tmp_path):
    edges = [(f"n{i}", "r", f"n{(i * 7 + 3) % 50}") for i in range(50)] + [("n1", "q", "n24"), ("n2", "r", "n2"), ("n1", "r", "n10")]
    relations = spark.createDataFrame(edges, "from_entity string, relation_type string, to_entity string")
    steps = graph.adjacency(relations, str(tmp_path / "a"), buckets=8)
    for source, hops in (("n1", 2), ("n9", 6), ("nowhere", 3)):
        plain = sorted(map(tuple, graph.bfs(relations, source, hops).collect()))
        assert sorted(map(tuple, graph.bfs(relations, source, hops, steps=steps, buckets=8).collect())) == plain
    assert steps.filter("bucket = 3")._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(bucket") == 1
