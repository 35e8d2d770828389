import json

from lodestar.operators import chunking
from lodestar.sources import sinks


def test_json(spark):
    df = spark.createDataFrame([(1, 'a"é', None)], "n long, s string, x double")
    assert json.loads(sinks.rows_json(df)) == {"columns": ["n", "s", "x"], "rows": [[1, 'a"é', None]], "row_count": 1}
    assert json.loads(sinks.affected_json(3)) == {"rows_affected": 3, "insert_id": 0}
    entities = spark.createDataFrame([("A", "t", ["o"])], "name string, entity_type string, observations array<string>")
    edges = spark.createDataFrame([("A", "knows", "B")], "from_entity string, relation_type string, to_entity string")
    assert json.loads(sinks.graph_json(entities, edges)) == {"entities": [{"name": "A", "entityType": "t", "observations": ["o"]}], "relations": [{"from": "A", "to": "B", "relationType": "knows"}]}
    hits = spark.createDataFrame([("d#0", "d", 0, "c", 0.12345678)], "id string, document_id string, ordinal int, content string, score double")
    assert json.loads(sinks.search_json(hits)) == {"results": [{"id": "d#0", "documentId": "d", "ordinal": 0, "score": 0.123457, "content": "c"}], "count": 1}


def test_extract_and_chunk(spark):
    df = spark.createDataFrame([(1, bytearray(b"<html><p>a b c</p><p>d</p></html>")), (2, bytearray(b"\x1f\x8bxx")), (3, None)], "id long, content binary")
    rows = chunking.extract_and_chunk(df, size=3, overlap=1).orderBy("id", "ordinal").collect()
    assert [(r.id, r.format, r.ordinal, r.content, r.token_count) for r in rows] == [(1, "html", 0, "a b c", 3), (1, "html", 1, "c d", 2)]
