import datetime
import decimal
import gzip
import io
import json
import time
import zipfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.functions.text import replace_invalid_utf8
from lodestar.sources import detect, extract


def got(data, fmt=None, name=None):
    out = extract.extract(data if isinstance(data, bytes) else data.encode(), name, fmt)
    return (out["text"], out["units"]) if out["status"] == "ok" else out["status"]


@pytest.mark.parametrize(
    ("fmt", "data", "expected"),
    [
        ("text", b"\xef\xbb\xbfnorth\rsouth\r\neast\n\nwest", ("north\nsouth\neast\n\nwest", 5)), ("text", b"\x80ok\xfe\xff", ("�ok��", 1)), ("text", b"a\xe2\x82A", ("a��A", 1)), ("text", b"", ("", 0)),
        ("csv", 'city,"remark ""x"""\r\n"Ulm, Donau","two\nrows"\r\n', ('city remark "x"\nUlm, Donau two\nrows\n', 2)), ("csv", "k,,,z\n\n\n,7\n", ("k   z\n 7\n", 2)), ("tsv", "u\tv,w\n", ("u v,w\n", 1)),
        ("json", '{"ship":{"crew":[{"n":"Ada"},"Bo"]},"":"key"}', ("ship crew n Ada Bo  key", 1)), ("json", '[{"gone":null,"on":false,"x":-0.25,"big":1e21,"s":""}]', ("gone on false x -0.25 big 1000000000000000000000 s", 1)), ("json", " {bad ", ("{bad", 0)),
        ("ndjson", '[7]\nnot json}\n\n{"w":"last"}', ("7\nw last", 2)),
        ("html", "<p>x &gt; y &quot;&copy;&#122;&#x3a9; &nix; &ndash;</p>", ('x > y "©zΩ &nix; –', 2)), ("xml", "<a>x<![CDATA[<y> &amp;]]><!-- no --> z<b", ("x<y> &amp; z", 2)),
        ("docx", None, None), ("iceberg", json.dumps({"format-version": 2, "table-uuid": "u1", "location": "s3://w/t", "current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": []}, {"schema-id": 1, "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": {"type": "struct"}}]}]}), ("table u1 location s3://w/t id:long s:struct", 2)),
        ("legacy_doc", bytes.fromhex("d0cf11e0a1b11ae1") + b"x", "pending"), ("legacy_doc", b"x", "corrupt"), ("gzip", b"x", "unsupported"), ("unknown", b"", "unsupported"), ("parquet", b"PAR1xxxxPAR1", "corrupt"),
    ],
)
def test_extract(fmt, data, expected):
    if data is None:
        body = "<w:p><w:r><w:t>Blue </w:t><w:t xml:space='preserve'>whale</w:t></w:r></w:p><w:p/><w:p><w:t>salt &lt; sea</w:t></w:p>"
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", body)
        assert got(box.getvalue()) == ("Blue whale\nsalt < sea\n", 2)
        assert got(b"PK\x03\x04junk") == "corrupt"
    else:
        assert got(data, fmt) == expected


def test_html_page():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>Hi<b>!</b> there<br>x</body></html>'
    assert got(page)[0] == "THi! there x"


def test_tables():
    t = pa.table({"id": pa.array([1, 4], pa.int64()), "town": ["Kiel", None], "depth": [0.125, None], "open": [False, None]})
    rows = ("id town depth open\n1 Kiel 0.125 false\n4   \n", 2)
    for codec in ("none", "snappy", "gzip", "zstd"):
        box = io.BytesIO()
        pq.write_table(t, box, compression=codec)
        assert got(box.getvalue()) == rows
    for open_ in (pa.ipc.new_stream, pa.ipc.new_file):
        box = io.BytesIO()
        with open_(box, t.schema) as w:
            w.write_table(t)
        assert got(box.getvalue()) == rows
    when = datetime.datetime(1999, 12, 31, 23, 5, 6)
    t = pa.table({"amount": pa.array([decimal.Decimal("-0.50")], pa.decimal128(5, 2)), "d": [when.date()], "ts": [when], "n": pa.array(["a"]).dictionary_encode(), "l": [[1, 2]]})
    box = io.BytesIO()
    pq.write_table(t, box)
    assert got(box.getvalue()) == ("amount d ts n l\n-0.50 1999-12-31 1999-12-31T23:05:06.000000000 a 1 2\n", 1)


def stream(number, body, extra=b""):
    return b"%d 0 obj<</Length %d%b>>stream\n%b\nendstream endobj\n" % (number, len(body), extra, body)


def test_pdf():
    assert extract.pdf_content(rb"BT [(Wx) 30 (\(y) -9 (z)] TJ ET") == "Wx(yz "
    assert extract.pdf_content(rb"BT (a\101\
b) Tj T* (x) ' <4142> Tj ET (no) Tj") == "aAb\n\nxAB "
    body = b"BT /F1 12 Tf (Hello) Tj ET"
    data = b"%PDF-1.4\n" + stream(1, zlib.compress(body), b"/Filter/FlateDecode") + stream(2, b"BT (two) Tj ET") + stream(3, b"\xff", b"/Filter/DCTDecode")
    assert got(data) == ("Hello two ", 2)
    assert got(b"%PDF-" + stream(1, body.hex().encode() + b">", b"/Filter[/ASCIIHexDecode]")) == ("Hello ", 1)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D83CDF0A> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    data = b"%PDF-" + stream(1, b"BT /F7 1 Tf <000100020003> Tj ET") + stream(5, cmap) + b"6 0 obj<</Type/Font/ToUnicode 5 0 R>>endobj 7 0 obj<</Font<</F7 6 0 R>>>>endobj"
    assert got(data) == ("🌊AB ", 1)
    assert extract._run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    assert extract._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert extract._ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"


@pytest.mark.parametrize(("data", "name", "expected"), [
    (b"%PDF-1", None, "pdf"), (gzip.compress(b"x"), None, "gzip"), (b"PK\x03\x04", None, "docx"), (b"ARROW1..ARROW1", None, "arrow"), (b"\xff\xff\xff\xff", None, "arrow"), (bytes.fromhex("d0cf11e0a1b11ae1"), None, "legacy_doc"),
    (b"x,y\n0,9\n", None, "csv"), (b"k\tv\n5\t6\n7\t8\n", None, "tsv"), (b'[1,2]\n{"z":[]}\n', None, "ndjson"), (b' [1]', None, "json"), (b'{"format-version":2,"table-uuid":"x"}', None, "iceberg"),
    (b"* item", "READ.Markdown", "markdown"), (b"a,b\n", "x.csv", "csv"), (b" \n", None, "unknown"), (None, None, "unknown"), (b"plain, words\nmore", None, "text"), (b"<x>", None, "xml"), (b"\n<!doctype x><HTML>", None, "html"),
])
def test_detect(data, name, expected):
    assert detect.detect(data, name) == expected
    assert ("iceberg" in detect.EXTRACTABLE) and "gzip" not in detect.EXTRACTABLE


def test_columns(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"k": 1}')
    (tmp_path / "b.bin").write_bytes(b"\x1f\x8b00")
    rows = extract.documents(spark, str(tmp_path)).select(extract.extracted(spark_col("content"), spark_col("path")).alias("x")).select("x.*").orderBy("format").collect()
    assert [(r.format, r.text, r.status) for r in rows] == [("gzip", None, "unsupported"), ("json", "k 1", "ok")]
    assert extract.source(spark, content_base64="aGk=").first().content == b"hi" and extract.source(spark, text_value="x").first().content == b"x"


@pytest.mark.parametrize(("fmt", "data", "expected"), [
    ("csv", "a," + "x" * 200_000 + "\n", "ok"), ("csv", 'a,"' + "y\n" * 100_000 + '"\n', "ok"), ("tsv", "\x00\t1\n", "ok"), ("json", "[" * 100_000 + "]" * 100_000, "unsupported"), ("ndjson", "[" * 100_000, "unsupported"),
    ("iceberg", "[1]", "corrupt"), ("iceberg", '{"schemas": 3, "schema": [], "location": 5}', "ok"), ("iceberg", '{"schemas": [7, {"fields": [null, {"name": 1}]}]}', "ok"), ("iceberg", "[" * 100_000, "corrupt"),
    ("docx", b"PK\x03\x04" + b"\x00" * 50, "corrupt"), ("arrow", b"ARROW1ARROW1", "corrupt"), ("pdf", b"%PDF-" + b"1 0 obj stream\n/ToUnicode 1 0 R", "ok"),
])
def test_never_raises(fmt, data, expected):
    out = extract.extract(data if isinstance(data, bytes) else data.encode(), None, fmt)
    assert out["status"] == expected and (out["text"] is None) == (expected != "ok")


def test_long_streams_are_no_prefixes(monkeypatch):
    monkeypatch.setattr(extract, "MOST_BYTES", 1000)
    for run, data in ((extract._inflate, zlib.compress(b"x" * 1001)), (extract._run_length, bytes([129, 65]) * 8)):
        with pytest.raises(extract.Unsupported):
            run(data)
    assert extract._inflate(zlib.compress(b"x" * 1000)) == b"x" * 1000
    page = b"%PDF-" + stream(1, zlib.compress(b"BT (a) Tj ET " * 500), b"/Filter/FlateDecode")
    assert got(page) == "unsupported"


def test_pdf_takes_linear_time():
    def seconds(data):
        began = time.perf_counter()
        extract.pdf(b"%PDF-" + data)
        return time.perf_counter() - began

    for piece in (b"1 0 obj\n", b"1 0 obj<<>>stream\nBT (x) Tj ET\n", b"1 0 obj /ToUnicode 2 0 R\n", b"1" * 8, b"stream\n"):
        assert seconds(piece * 16_000) < 20 * seconds(piece * 2_000) + 0.5


def test_pdf_objects():
    inner = b"BT (1 0 obj) Tj ET 9 0 obj"
    data = b"%PDF-1.4\n1 0 obj<</A 2 0 R>>endobj\n" + stream(2, inner) + b"3 0 obj<</S (upstream)>>endobj" + stream(4, b"BT (b) Tj ET")
    assert [(n, body) for n, _, body in extract._objects(data)] == [(1, None), (2, inner + b"\n"), (3, None), (4, b"BT (b) Tj ET\n")]
    assert got(data) == ("1 0 obj b ", 2)
    wide = b"1 begincodespacerange <00000000> <FFFFFFFF> endcodespacerange 1 beginbfrange <00000000> <00FFFFFF> <0041> endbfrange"
    assert extract.CharMap(wide).show(bytes([0, 0, 0, 1, 0, 1, 0, 0])) == "B" + extract._hex(b"%04x" % (0x41 + 0x10000)).decode("utf-16-be", "replace")


def test_parquet_rows(spark, tmp_path):
    t = pa.table({"x": [1e30, 1e-14, float("nan"), None, -2.0], "b": [b"\xff1", b"", None, b"ok", b"z"], "l": [[1.5, None], [], None, [2.0], [3.0]], "t": pa.array([0, 1, None, 2, 3], pa.timestamp("us")), "n": [True, None, False, True, False]})
    pq.write_table(t, tmp_path / "t.parquet")
    lines = [r.line for r in extract.parquet_rows(spark, str(tmp_path / "t.parquet"), header=True).collect()]
    whole = extract.extract((tmp_path / "t.parquet").read_bytes())["text"]
    assert sorted(lines) == sorted(whole.splitlines())


def test_negative_zero_in_tables(spark, tmp_path):
    """A balance that rounds to zero from below reads as in the query's SQL."""
    import duckdb

    from lodestar import queries as own

    t = pa.table({"c_custkey": [1, 2, 3, 4], "c_name": ["a", "b", "c", "d"], "c_nationkey": pa.array([5, 6, 7, 8], pa.int32()), "c_acctbal": [-0.0, 0.0, -0.01, -120.5], "c_mktsegment": ["x"] * 4})
    pq.write_table(t, tmp_path / "customer.parquet")
    found = sorted(r.line for r in own.QUERIES["parquet_with_header"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.register("customer", t)
        assert found == sorted(line for (line,) in c.sql(own.SQL["parquet_with_header"]).fetchall())
    assert found[:2] == ["1 a 5 0 x", "2 b 6 0 x"]
    nested = pa.table({"l": [[-0.0, 1.5]], "f": pa.array([-0.0], pa.float32())})
    pq.write_table(nested, tmp_path / "nested.parquet")
    assert [r.line for r in extract.parquet_rows(spark, str(tmp_path / "nested.parquet")).collect()] == ["0 1.5 0"]
    assert extract.extract((tmp_path / "nested.parquet").read_bytes())["text"] == "l f\n0 1.5 0\n"


def test_invalid_utf8(spark):
    values = [b"plain", b"\xe2\x82A\xff", "é".encode(), None, b"\xf0\x9f\x98"]
    rows = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, v binary")
    found = [r.t for r in rows.orderBy("i").select(replace_invalid_utf8(spark_col("v")).alias("t")).collect()]
    assert found == ["plain", "\ufffd\ufffdA\ufffd", "é", None, "\ufffd" * 3]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
