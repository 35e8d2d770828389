"""Bounded results as JSON text, for callers that want what a tool server would answer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(value: object) -> object:
    return value if value is None or isinstance(value, (int, float, str, bool, list)) else str(value)


def rows_json(df: DataFrame, limit: int = 1000) -> str:
    """columns, rows, row_count of at most ``limit`` rows: this is for pages of results, not for tables."""
    rows = [[_plain(v) for v in r] for r in df.limit(limit).collect()]
    return json.dumps({"columns": df.columns, "rows": rows, "row_count": len(rows)}, ensure_ascii=False)


def affected_json(rows: int, insert_id: int = 0) -> str:
    return json.dumps({"rows_affected": rows, "insert_id": insert_id})


def graph_json(entities: DataFrame, relations: DataFrame, limit: int = 1000) -> str:
    found = [{"name": r.name, "entityType": r.entity_type, "observations": list(r.observations or [])} for r in entities.limit(limit).collect()]
    edges = [{"from": r.from_entity, "to": r.to_entity, "relationType": r.relation_type} for r in relations.limit(limit).collect()]
    return json.dumps({"entities": found, "relations": edges}, ensure_ascii=False)


def search_json(found: DataFrame, measure: str = "score", limit: int = 1000) -> str:
    """Hits with score or distance to six digits."""
    rows = found.select("id", F.col("document_id").alias("documentId"), "ordinal", F.round(measure, 6).alias(measure), "content").limit(limit).collect()
    return json.dumps({"results": [r.asDict() for r in rows], "count": len(rows)}, ensure_ascii=False)


def json_lines(df: DataFrame, path: str) -> None:
    """A whole table as JSON lines, one file for each task."""
    df.write.mode("overwrite").json(path)
