import base64
import gzip
import hashlib
import pathlib
import random
import time

from lodestar.llm import warc


def rows():
    big = "é" * 600
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50), (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "日" * 40000), (11, "u", "日" * 40000), (None, "u", big), (12, "u", "a\x00b\r\r\n")]


def brute(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = max(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and (html or "") in first and first[html or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 5) for r in rows()], "page_id long, url string, html string, payload int")
    got = warc.round_trip(df, warc.Settings(archive_bytes=50_000)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())
    assert warc.round_trip(df.limit(0)).collect() == []


def record(text, kind=b"response", digest=None):
    body = text.encode()
    digest = digest or hashlib.sha1(body).hexdigest()
    return b"WARC/1.1\r\nWARC-Type: %b\r\nWARC-Payload-Digest: sha1:%b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (kind, digest.encode(), len(body), body)


def got(data):
    found = list(warc.salvage(data))
    assert [a for a, *_ in found] == [0, *(b for _, b, *_ in found)][: len(found)] and (not data or found[-1][1] == len(data))
    return [(body.decode() if head is not None else None) for _, _, head, body, _ in found]


def test_salvage():
    a, b, c = record("first"), record("second"), record("third")
    assert got(a + b + c) == ["first", "second", "third"]
    assert got(a + b[:-9] + c) == ["first", None, "third"]
    assert got(a + b.replace(b"second", b"sEcond") + c) == ["first", None, "third"]
    assert got(a + b.replace(b"Length: 6", b"Length: x") + c) == ["first", None, "third"]
    assert got(b"junk" + a + b"\x00\x01" + c) == [None, "first", None, "third"]
    assert got(a + c[:30]) == ["first", None]
    assert got(b"") == [] and got(b"x") == [None]
    z = [gzip.compress(x) for x in (a, b, c)]
    assert got(b"".join(z)) == ["first", "second", "third"]
    broken = bytearray(z[1])
    broken[-6] ^= 1
    assert got(z[0] + bytes(broken) + z[2]) == ["first", None, "third"]
    assert got(z[0] + z[1][:-7] + z[2] + a) == ["first", None, "third", "first"]


def standard(content, payload=None, version=b"1.0", form="base32", more=b""):
    show = lambda x: base64.b32encode(hashlib.sha1(x).digest()) if form == "base32" else hashlib.sha1(x).hexdigest().upper().encode()
    lines = [b"WARC/" + version, b"WARC-Type: response", b"WARC-Target-URI: http://a/", b"WARC-Block-Digest: sha1:" + show(content)]
    lines += [b"WARC-Payload-Digest: sha1:" + show(payload)] if payload is not None else []
    return b"\r\n".join([*lines, b"Content-Type: application/http;\r\n\tmsgtype=response", b"Content-Length: %d" % len(content)]) + more + b"\r\n\r\n" + content + b"\r\n\r\n"


def test_standard_records():
    top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    a, b, c = (top + x for x in (b"one", b"two", b"three"))
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    text = lambda *x: [y.decode() if y else None for y in x]
    for version in (b"1.0", b"1.1"):
        for form in ("base32", "hex"):
            r = [standard(x, x[len(top) :], version, form) for x in (a, b, c)]
            assert got(b"".join(r)) == text(a, b, c)
            assert got(gzip.compress(b"".join(r))) == text(a, b, c)
            assert got(gzip.compress(r[0]) + gzip.compress(r[1] + r[2]) + r[0]) == text(a, b, c, a)
    assert got(standard(chunked, b"abcde") + standard(chunked, chunked.split(b"\r\n\r\n", 1)[1])) == text(chunked, chunked)
    assert got(standard(a, b"one") + standard(b, b"other") + standard(c, b"three")) == text(a, None, c)
    broken = standard(b).replace(b"two", b"tWo")
    assert got(standard(a) + broken + standard(c)) == text(a, None, c)
    assert got(gzip.compress(standard(a) + broken + standard(c))) == text(a, None, c)
    assert [x[4] for x in warc.salvage(gzip.compress(standard(a) + broken))] == [None, "bad record in a gzip member"]
    assert got(gzip.compress(broken)) == [None]
    unknown = standard(a, b"one").replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: blake3:")
    assert got(unknown + standard(a, b"part", more=b"\r\nWARC-Truncated: length")) == text(a, a)


def test_quarantine_log(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record("one") + b"###" + record("two"))
    log = warc.read(spark, str(tmp_path)).filter("reason is not null").collect()
    assert [(r.first_byte, r.end_byte, r.reason) for r in log] == [(len(record("one")), len(record("one")) + 3, "bad record")]


def test_archives_roll_by_size(spark, tmp_path):
    """Payloads of very different lengths: files of several records stay below the bound, and nothing is lost."""
    rng = random.Random(4)
    pages = [(i, "u", rng.choice("xyzé") * rng.choice([0, 10, 400, 3000, 20_000, 90_000])) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    settings = warc.Settings(archive_bytes=1 << 16)
    warc.write(warc.records(df, settings), str(tmp_path / "a"), settings)
    files = [f for f in (tmp_path / "a").iterdir() if f.suffix == ".txt"]
    several = [f.stat().st_size for f in files if f.read_bytes().count(b"WARC/1.1") > 1]
    assert several and max(several) <= 1 << 16 and max(f.stat().st_size for f in files) > 1 << 16
    found = warc.read(spark, str(tmp_path / "a")).filter("headers is not null")
    assert found.count() == 300


def test_groups_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(rows())


def test_null_ids_with_equal_payloads(spark):
    pages = [(None, "u", "z" * 2000), (None, "u", "z" * 2000), (4, "u", "z" * 2000), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted([(4, "response", None), *[(None, "revisit", 4)] * 2, *[(None, "response", None)] * 2], key=str)


def test_no_archives_stay(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "lodestar"
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    warc.round_trip(df).collect()
    assert not list(shared.glob("warc-*/*.txt"))


def test_many_broken_starts_take_linear_time():
    def seconds(n, line):
        began = time.perf_counter()
        assert got(line * n) == [None]
        return time.perf_counter() - began

    for line in (b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 5\r\n\r\nab", b"\x1f\x8b\x08\x00"):
        assert seconds(64_000, line) < 20 * seconds(8_000, line) + 0.5


def test_members_are_unpacked_to_a_bound():
    a, bomb = gzip.compress(record("first")), gzip.compress(b"\x00" * (1 << 22))
    found = list(warc.salvage(a + bomb + a, 1 << 20))
    assert [(r[3], r[4]) for r in found] == [(b"first", None), (b"", "gzip member too long"), (b"first", None)]
    assert [r[3] for r in warc.salvage(gzip.compress(record("x" * (1 << 21))))] == [b"x" * (1 << 21)]


def test_lines_of_headers():
    body = b"WARC/1.0\r\nContent-Length: 3\r\nX-Long: a\r\n\t b\r\n\r\nabc\r\n\r\n"
    assert [r[2] for r in warc.salvage(body)] == [{"content-length": "3", "x-long": "a b"}]
    assert got(body.replace(b"X-Long: a", b"X-Long a")) == [None]
    assert got(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") == [None]
