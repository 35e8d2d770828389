"""Queries of formats, functions and sinks: content is made from the test tables' rows, and its text compared."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text, vectors
from lodestar.plans import corpus
from lodestar.plans.config import TIERS
from lodestar.registry import query
from lodestar.sources import extract, sinks


def _made(spark, sf_dir: str, table: str, key: str, name: str, make: Callable[[int, str], bytes], fmt: str | None = None) -> DataFrame:
    """Text of bytes that ``make`` gives for each row's key and name; the format is detected unless given."""

    @F.pandas_udf("binary")
    def content(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([make(int(k), n) for k, n in zip(keys, names, strict=True)], dtype=object)

    found = corpus.table(spark, sf_dir, table).select(F.col(key).cast("long").alias("key"), extract.extracted(content(key, name), fmt=fmt).alias("x"))
    return found.select("key", "x.format", "x.text", "x.units", "x.status")


def _docx(key: int, name: str) -> bytes:
    box = io.BytesIO()
    body = f"<w:p><w:r><w:t>{name}</w:t><w:tab/><w:t xml:space='preserve'> &lt;{key}&gt;</w:t></w:r></w:p><w:p/><w:p><w:t>end</w:t><w:br/></w:p>"
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED if key % 2 else zipfile.ZIP_STORED) as z:
        z.writestr("word/document.xml", body)
    return box.getvalue()


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, 'docx' AS format, n_name || chr(9) || ' <' || n_nationkey || '>' || chr(10) || 'end' || chr(10) || chr(10) AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM nation")
def docx_to_text(spark, sf_dir):
    return _made(spark, sf_dir, "nation", "n_nationkey", "n_name", _docx)


def _run_lengths(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


#: Filters of a stream by key, and how it is written for them.
FILTERS = (
    (b"", lambda d: d), (b"/Filter/FlateDecode", zlib.compress), (b"/Filter/ASCIIHexDecode", lambda d: d.hex().encode() + b">"),
    (b"/Filter[/ASCII85Decode /FlateDecode]", lambda d: base64.a85encode(zlib.compress(d)) + b"~>"), (b"/Filter/RunLengthDecode", _run_lengths),
)


def _pdf(key: int, name: str) -> bytes:
    """One page whose second string is in a font with a map of codes; its first code stands for a letter beyond the plane."""
    label, write = FILTERS[key % len(FILTERS)]
    shown = name.replace("(", r"\(").replace(")", r"\)").encode()
    body = write(b"BT /F1 9 Tf (" + shown + rb" \(x\)\056) Tj T* /F2 9 Tf <00010003> Tj ET")
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D83CDF33> endbfchar 1 beginbfrange <0002> <0009> <0061> endbfrange"
    page = b"1 0 obj<</Length %d%b>>stream\n%b\nendstream endobj\n" % (len(body), label, body)
    return b"%PDF-1.4\n" + page + b"2 0 obj<<>>stream\n" + cmap + b"\nendstream endobj 3 0 obj<</ToUnicode 2 0 R>>endobj 4 0 obj<</F2 3 0 R>>endobj"


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, 'pdf' AS format, n_name || ' (x).' || chr(10) || chr(127795) || 'b ' AS text, CAST(1 AS BIGINT) AS units, 'ok' AS status FROM nation")
def pdf_to_text(spark, sf_dir):
    return _made(spark, sf_dir, "nation", "n_nationkey", "n_name", _pdf)


def _two_rows(key: int, name: str) -> pa.Table:
    return pa.table({"k": pa.array([key, None], pa.int32()), "name": [name, name], "half": [key / 2, -1.0], "odd": [key % 2 == 1, None]})


def _parquet(key: int, name: str) -> bytes:
    box = io.BytesIO()
    more = {} if key % 2 else {"use_dictionary": False, "column_encoding": {"k": "DELTA_BINARY_PACKED", "name": "DELTA_BYTE_ARRAY"}}
    pq.write_table(_two_rows(key, name), box, compression=("none", "snappy", "gzip", "zstd")[key % 4], data_page_version=("1.0", "2.0")[key % 2], **more)
    return box.getvalue()


def _arrow(key: int, name: str) -> bytes:
    box, table = io.BytesIO(), _two_rows(key, name)
    table = table.set_column(1, "name", table["name"].dictionary_encode())
    with (pa.ipc.new_file if key % 2 else pa.ipc.new_stream)(box, table.schema) as w:
        w.write_table(table)
    return box.getvalue()


TWO_ROWS = "'k name half odd' || chr(10) || n_nationkey || ' ' || n_name || ' ' || regexp_replace(CAST(n_nationkey / 2 AS VARCHAR), '\\.0$', '') || ' ' || (n_nationkey % 2 = 1) || chr(10) || ' ' || n_name || ' -1 ' || chr(10)"


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS key, 'parquet' AS format, {TWO_ROWS} AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM nation")
def parquet_bytes_to_text(spark, sf_dir):
    return _made(spark, sf_dir, "nation", "n_nationkey", "n_name", _parquet)


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS key, 'arrow' AS format, {TWO_ROWS} AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM nation")
def arrow_to_text(spark, sf_dir):
    return _made(spark, sf_dir, "nation", "n_nationkey", "n_name", _arrow)


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, 'iceberg' AS format, 'table u-' || n_nationkey || ' location s3://w/' || n_name || ' id:long ' || n_name || ':struct' AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM nation")
def iceberg_to_text(spark, sf_dir):
    make = lambda k, n: ('{"format-version":2,"table-uuid":"u-%d","location":"s3://w/%s","current-schema-id":4,"schemas":[{"schema-id":3,"fields":[]},{"schema-id":4,"fields":[{"name":"id","type":"long"},{"name":"%s","type":{"type":"struct"}}]}]}' % (k, n, n)).encode()  # noqa: E731, UP031
    return _made(spark, sf_dir, "nation", "n_nationkey", "n_name", make)


#: Bytes, the format they are said to have, and what comes of it.
STATUSES = (
    (b"\x1f\x8b\x08\x00", None, "gzip", "unsupported"), (bytes.fromhex("d0cf11e0a1b11ae1"), None, "legacy_doc", "pending"), (b"x", "legacy_doc", "legacy_doc", "corrupt"), (b"", None, "unknown", "unsupported"),
    (b"PK\x03\x04 no archive", None, "docx", "corrupt"), (b"PAR1 no table PAR1", None, "parquet", "corrupt"), (b"ARROW1 no table ARROW1", None, "arrow", "corrupt"), (b"no page", "pdf", "pdf", "corrupt"),
    (b"[" * 50_000, "json", "json", "unsupported"), (b"[1]", "iceberg", "iceberg", "corrupt"), (b"words", "video", "video", "unsupported"), (None, None, "unknown", "unsupported"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), '{f}', '{s}', {str(f in extract.EXTRACTABLE).lower()}, true)" for i, (_, _, f, s) in enumerate(STATUSES)) + ") AS t(n, format, status, extractable, empty)")
def extract_statuses(spark, sf_dir):
    """What can't be read gives a status and no text."""
    out = None
    for i, (data, fmt, _, _) in enumerate(STATUSES):
        x = extract.extracted(F.lit(None if data is None else bytearray(data)).cast("binary"), fmt=fmt)
        part = spark.range(1).select(F.lit(i).alias("n"), x.alias("x")).select("n", "x.format", "x.status", "x.extractable", F.col("x.text").isNull().alias("empty"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'csv' WHEN 2 THEN 'text' ELSE 'ndjson' END AS format FROM documents")
def detect_by_name(spark, sf_dir):
    """Plain words in files whose names hint at a format, or don't."""
    name = F.concat(F.col("doc_id").cast("string"), F.get(F.array(*(F.lit(x) for x in (".MD", ".csv", ".bin", ".jsonl"))), (F.col("doc_id") % 4).cast("int")))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", extract.detected(F.lit(b"just words"), name).alias("format"))


@query("SELECT o_orderkey || ' ' || o_custkey || ' ' || o_orderstatus || ' ' || regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') || ' ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || '000000000 ' || o_orderpriority AS line FROM orders")
def times_to_text(spark, sf_dir):
    return extract.parquet_rows(spark, f"{sf_dir}/orders.parquet")


# functions


@query(r"""SELECT event_id, event_type AS trimmed, json_extract_string(props, '$.k') AS k, [event_type, 'a"b', ''] AS listed, CAST([] AS VARCHAR[]) AS none, true AS is_number, false AS is_none,
CAST(0.5 + event_id % 7 AS DOUBLE) AS summed, event_type || chr(128512) AS wide, event_type AS decoded, [event_type, 'x', event_type] AS parts FROM events""")
def text_functions(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    listed = F.to_json(F.array(kind, F.lit('a"b'), F.lit("")))
    numbers = F.concat(F.lit("[0.5, "), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    units = F.unhex(F.concat(F.hex(F.encode(kind, "UTF-16BE")), F.lit("D83DDE00")))
    return e.select(
        "event_id", text.trim_space(F.concat(F.lit("\t \x0b"), kind, F.lit(" \r\n"))).alias("trimmed"), F.get_json_object("props", "$.k").alias("k"), text.string_list(listed).alias("listed"), text.string_list(kind).alias("none"),
        text.is_json_number(F.concat(F.lit("-0.5e"), F.col("event_id").cast("string"))).alias("is_number"), text.is_json_number(F.concat(F.lit("0"), F.col("event_id").cast("string"))).alias("is_none"),
        F.aggregate(text.vector(numbers), F.lit(0.0), lambda s, x: s + x.cast("double")).alias("summed"), F.decode(units, "UTF-16BE").alias("wide"), F.unbase64(F.base64(kind.cast("binary"))).cast("string").alias("decoded"),
        F.split(F.concat_ws(". ", kind, F.lit("x"), kind), r"\Q. \E").alias("parts"),
    )


@query("SELECT p_partkey, '�' || p_name || '��é' AS text FROM part")
def utf8_repair(spark, sf_dir):
    content = F.concat(F.lit(b"\xff"), F.col("p_name").cast("binary"), F.lit(b"\xe2\x82\xc3\xa9"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", text.replace_invalid_utf8(content).alias("text"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE) * x)), 5) AS own, CAST(1.0 AS DOUBLE) AS same, CAST(0.0 AS DOUBLE) AS zero FROM embeddings")
def vector_functions(spark, sf_dir):
    """Products over the shared length; a zero or non-finite vector is like nothing."""
    e, short = F.col("embedding"), F.slice("embedding", 1, 9)
    none = F.transform(e, lambda x: x * 0)
    own = F.round(vectors.dot(*(F.slice(x, 1, 9) for x in (e, short))), 5)
    return corpus.table(spark, sf_dir, "embeddings").select("vec_id", own.alias("own"), F.round(vectors.cosine(e, e), 9).alias("same"), (vectors.cosine(e, none) + vectors.cosine(e, F.transform(e, lambda x: F.lit(float("inf"))))).alias("zero"))


@query("SELECT * FROM (VALUES ('mobile', 20, 200, 100), ('edge', 100, 1000, 500), ('server', 200, 2000, 1000), ('dc', 1000, 20000, 5000)) AS t(tier, k, candidates, mmr)")
def limits_by_tier(spark, sf_dir):
    """What is left of a very large k and number of candidates."""
    return spark.createDataFrame([(t, v.k(10**9), v.candidates(10**9), v.mmr_max_n) for t, v in TIERS.items()], "tier string, k int, candidates int, mmr int")


# sinks


@query("""SELECT 'rows' AS kind, '{"columns": ["r_regionkey", "r_name"], "rows": [' || string_agg('[' || r_regionkey || ', "' || r_name || '"]', ', ' ORDER BY r_regionkey) || '], "row_count": ' || count(*) || '}' AS json FROM region
UNION ALL SELECT 'affected', '{"rows_affected": ' || count(*) || ', "insert_id": 0}' FROM region
UNION ALL SELECT 'graph', '{"entities": [' || string_agg('{"name": "' || n_name || '", "entityType": "nation", "observations": ["' || n_nationkey || '"]}', ', ' ORDER BY n_nationkey) || '], "relations": [' || string_agg('{"from": "' || n_name || '", "to": "region:' || n_regionkey || '", "relationType": "in"}', ', ' ORDER BY n_nationkey) || ']}' FROM nation
UNION ALL SELECT 'search', '{"results": [' || string_agg('{"id": "' || r_name || '#0", "documentId": "' || r_name || '", "ordinal": 0, "score": 0.333333, "content": "a\\"b"}', ', ' ORDER BY r_regionkey) || '], "count": ' || count(*) || '}' FROM region""")
def json_results(spark, sf_dir):
    """Results as the JSON text that callers get."""
    region, nation = corpus.table(spark, sf_dir, "region").orderBy("r_regionkey"), corpus.table(spark, sf_dir, "nation").orderBy("n_nationkey")
    entities = nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.array(F.col("n_nationkey").cast("string")).alias("observations"))
    relations = nation.select(F.col("n_name").alias("from_entity"), F.concat(F.lit("region:"), "n_regionkey").alias("to_entity"), F.lit("in").alias("relation_type"))
    hits = region.select(F.concat("r_name", F.lit("#0")).alias("id"), F.col("r_name").alias("document_id"), F.lit(0).alias("ordinal"), F.lit(1 / 3).alias("score"), F.lit('a"b').alias("content"))
    rows = [("rows", sinks.rows_json(region)), ("affected", sinks.affected_json(region.count())), ("graph", sinks.graph_json(entities, relations)), ("search", sinks.search_json(hits))]
    return spark.createDataFrame(rows, "kind string, json string")
