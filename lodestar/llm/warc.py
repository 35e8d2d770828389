"""WARC archives: a writer and a salvage reader.

The writer makes plain ``.warc`` files with Spark's text sink: a record is one
value of raw bytes, and the line separator is the CR LF CR LF that ends every
record, so files are written by tasks under the usual commit protocol. Tasks
write the partitions that they scan; payloads are not shuffled.

The reader takes whole files of WARC/1.0 or 1.1 as bytes and expects members
(gzip, of one record or more) or version lines (plain). Where a record fails its checks it looks for the next valid
start, goes on from there, and logs the bytes that it skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import scratch

VERSION = b"WARC/1.1\r\n"
START = re.compile(rb"WARC/1\.[01]\r\n")
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n")
GZIP = b"\x1f\x8b\x08"
RECORD_END = "\r\n\r\n"
#: Payload groups are broadcast up to this many (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: A gzip member that unpacks to more than this is quarantined, as no task could hold it.
MOST_MEMBER = 1 << 30
#: Arrow batches of archives; a longer archive is a batch of its own.
BATCH_BYTES = 8 << 20
#: Spark reads files of fewer bytes than this; a longer archive is quarantined whole.
MOST_ARCHIVE = (1 << 31) - 64


@dataclass(frozen=True)
class Settings:
    """Payloads of fewer than ``least_revisit`` bytes are never revisits. An archive of several records holds at most ``archive_bytes``, which bounds what a reading task holds."""

    least_revisit: int = 1000
    archive_bytes: int = 16 << 20


def records(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, record): one WARC record for each row of ``pages``, without its end.

    Of records with equal payloads of at least ``least_revisit`` bytes, those
    with the largest page_id are responses, the others revisits. A null html is
    an empty payload; a null page_id is smaller than any other, and no page can refer to it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = base.filter(F.col("size") >= settings.least_revisit).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = scratch.table(groups.filter("n > 1 and first is not null").select("digest", "first"), "payload-groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    if few:
        placed = base.join(F.broadcast(groups), "digest", "left")
    else:  # small payloads, of which very many may be equal, have no group and stay out of the shuffle
        small = base.filter(F.col("size") < settings.least_revisit)
        placed = base.filter(F.col("size") >= settings.least_revisit).join(groups, "digest", "left").unionByName(small.withColumn("first", F.lit(None).cast("long")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Refers-To", name(F.col("first")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return placed.select("page_id", F.concat(head, body).alias("record"))


def write(found: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Write (page_id, record) as archives below ``path``, each task the records that it has.

    Spark rolls files by records, so records are written by size, a class at a
    time: all of a class are at most 16 times smaller than its longest may be,
    and as many go into a file as fit if all are longest. A record longer than
    ``archive_bytes`` is a file of its own.
    """
    size = F.octet_length("record") + len(RECORD_END)
    tops = [max(1, settings.archive_bytes >> shift) for shift in (12, 8, 4, 0)]
    kind = reduce(lambda a, b: a + b, ((size > top).cast("int") for top in tops))
    held = sorted(r.kind for r in found.select(kind.alias("kind")).distinct().collect())
    for k in held:
        n = max(1, settings.archive_bytes // tops[k]) if k < len(tops) else 1
        own = found if len(held) == 1 else found.filter(kind == k)
        lines = own.select(F.col("record").cast("string").alias("value"))
        lines.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", n).mode("append").text(path)


class _Finder:
    """Positions of a pattern in some bytes for askers that only move on: every byte is searched once."""

    def __init__(self, find: Callable[[int], int], length: int):
        self._find, self._length, self._next = find, length, -1

    def at_or_after(self, at: int) -> int:
        """The next position, or the length if there is none."""
        if self._next < at:
            found = self._find(at)
            self._next = found if found >= 0 else self._length
        return self._next


class _Bytes:
    """Some bytes with what the reader looks for in them."""

    def __init__(self, data: bytes):
        self.data = data
        first = lambda m: m.start() if m else -1
        self.start = _Finder(lambda at: first(START.search(data, at)), len(data))
        self.gzip = _Finder(lambda at: data.find(GZIP, at), len(data))
        self.blank = _Finder(lambda at: data.find(b"\r\n\r\n", at), len(data))


def _headers(data: bytes, at: int, stop: int) -> dict[str, str] | None:
    """Header lines from ``at`` to ``stop``; None at the first line that is none, without a look at the rest."""
    out, key = {}, None
    while at < stop:
        end = data.find(b"\r\n", at, stop)
        end = stop if end < 0 else end
        line = data[at:end]
        if line[:1] in (b" ", b"\t") and key is not None:
            out[key] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, colon, value = line.partition(b":")
            if not colon:
                return None
            key = name.strip().lower().decode("latin-1")
            out[key] = value.strip().decode("utf-8", "replace")
        at = end + 2
    return out


def _agrees(label: str, data: bytes) -> bool | None:
    """Whether ``algorithm:digest``, in hex or base32, is that of the bytes; None if it cannot be told."""
    name, _, digest = label.partition(":")
    name, digest = name.strip().lower().replace("-", ""), digest.strip().rstrip("=")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own = hashlib.new(name, data, usedforsecurity=False).digest()
    if len(digest) == 2 * len(own):
        return digest.lower() == own.hex()
    own32 = base64.b32encode(own).decode().rstrip("=")
    return digest.upper() == own32 if len(digest) == len(own32) else None


def _unchunked(body: bytes) -> bytes | None:
    out, at = [], 0
    while size := CHUNK.match(body, at):
        n, at = int(size[1], 16), size.end()
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2
    return None


def _payload_fails(head: dict[str, str], content: bytes) -> bool:
    """True if the payload is whole in this record and its digest is another one. Of HTTP messages it is the body, as sent or with its chunks joined."""
    label, kind = head.get("warc-payload-digest", ""), head.get("content-type", "").lower()
    if head.get("warc-type") not in ("response", "resource", "request", "conversion") or "warc-truncated" in head or "warc-segment-number" in head:
        return False
    if not (kind.startswith("application/http") or (not kind and content.startswith(b"HTTP/"))):
        return _agrees(label, content) is False
    top, end, body = content.partition(b"\r\n\r\n")
    if not end or _agrees(label, body) is not False:
        return False
    if not re.search(rb"(?im)^transfer-encoding:", top):
        return True
    joined = _unchunked(body)
    return joined is not None and _agrees(label, joined) is False


def _parse(own: _Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record that begins at ``at``: headers, content, and where it ends; None if a check fails. A digest that cannot be verified is no failure."""
    data = own.data
    version = START.match(data, at)
    stop = own.blank.at_or_after(at) if version else len(data)
    if stop == len(data):
        return None
    head = _headers(data, version.end(), stop)
    if head is None or not head.get("content-length", "").isdecimal():
        return None
    start = stop + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != RECORD_END.encode():
        return None
    content = data[start:end]
    if _agrees(head.get("warc-block-digest", ""), content) is False or _payload_fails(head, content):
        return None
    return head, content, end + 4


def _member(data: bytes, at: int, most: int) -> tuple[bytes | None, int, str]:
    """The gzip member at ``at``: its bytes unpacked, where it ends, and why it has none (a wrong checksum or form, or more than ``most`` bytes)."""
    unpack, out, held, low = zlib.decompressobj(31), [], 0, at
    try:
        while not unpack.eof and low < len(data):
            piece = data[low : low + (1 << 16)]
            low += len(piece)
            while piece and not unpack.eof:
                out.append(unpack.decompress(piece, 1 << 20))
                held += len(out[-1])
                if held > most:
                    return None, at, "gzip member too long"
                piece = unpack.unconsumed_tail
    except zlib.error:
        return None, at, "bad gzip member"
    if not unpack.eof:
        return None, at, "bad gzip member"
    return b"".join(out), low - len(unpack.unused_data), ""


def _records(unpacked: bytes) -> list[tuple[dict[str, str] | None, bytes]]:
    """Headers and content of the records of an unpacked member; a stretch that is none has no headers."""
    own, out, at = _Bytes(unpacked), [], 0
    while at < len(unpacked):
        if found := _parse(own, at):
            out.append(found[:2])
            at = found[2]
            continue
        if not out or out[-1][0] is not None:
            out.append((None, b""))
        at = own.start.at_or_after(at + 1)
    return out


def salvage(data: bytes, most_member: int = MOST_MEMBER) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """Records and gaps of one archive in order: (first byte, end, headers, content, reason).

    A gap has no headers and a reason. Bytes are never in two of them, and
    together they cover the archive. Of a gzip member with several records the
    first covers its bytes, the others none; what is broken in a member that
    holds sound records too is a gap among them. A member that unpacks to more
    than ``most_member`` bytes is a gap. Each search for a next start goes on
    where the last one ended, so many broken starts cost no more than one.
    """
    own, at, gap, reason = _Bytes(data), 0, -1, ""
    while at < len(data):
        found, end, why = [], at, "bad record"
        if data.startswith(GZIP, at):
            unpacked, end, why = _member(data, at, most_member)
            if unpacked is not None:
                found, why = _records(unpacked), "bad gzip member"
        elif record := _parse(own, at):
            found, end = [record[:2]], record[2]
        if any(head is not None for head, _ in found):
            if gap >= 0:
                yield gap, at, None, b"", reason
                gap = -1
            for head, content in found:
                yield at, end, head, content, None if head is not None else "bad record in a gzip member"
                at = end
            continue
        if gap < 0:
            gap, reason = at, why
        at = min(own.start.at_or_after(at + 1), own.gzip.at_or_after(at + 1))
    if gap >= 0:
        yield gap, len(data), None, b"", reason


ROW = "path string, first_byte long, end_byte long, headers map<string,string>, content binary, reason string"


def _read(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "first_byte", "end_byte", "headers", "content", "reason"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    for batch in incoming:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for a, b, head, body, reason in salvage(content.as_py() or b""):
                rows.append((path.as_py(), a, b, list(head.items()) if head is not None else None, body, reason))
                held += len(body)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :func:`salvage` for every archive below ``path``: path, first_byte, end_byte, headers, content, reason.

    Gaps, the rows with a reason, are the quarantine log. Empty archives have no
    rows; one of ``MOST_ARCHIVE`` bytes or more is a single gap.
    """
    files = spark.read.format("binaryFile").load(path)
    found = files.filter((F.col("length") > 0) & (F.col("length") < MOST_ARCHIVE)).select("path", "content").mapInArrow(_read, ROW)
    none = lambda kind: F.lit(None).cast(kind)
    long = files.filter(F.col("length") >= MOST_ARCHIVE).select("path", F.lit(0).cast("long"), "length", none("map<string,string>"), none("binary"), F.lit("archive too long for a task"))
    return found.union(long)


@scratch.settled("warc-digest", BATCH_BYTES)
def round_trip(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of ``pages``, repeated ones and null ids too; extra
    columns are not read. Sizes and digests of responses are taken from the bytes
    read, those of revisits from their headers. No rows in, no rows out. The
    archives are deleted once they are read.
    """
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    write(records(pages, settings), path, settings)
    return _digest(read(spark, path) if not pages.isEmpty() else spark.createDataFrame([], ROW))


def _digest(found: DataFrame) -> DataFrame:
    found = found.filter("headers is not null")
    head = lambda k: F.col("headers").getItem(k)
    revisit = head("warc-type") == "revisit"
    number = lambda c: F.expr(f"try_cast(regexp_extract(headers['{c}'], '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return found.select(
        number("warc-record-id").alias("page_id"),
        F.when(revisit, head("x-payload-length").cast("long")).otherwise(F.length("content").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring(head("warc-payload-digest"), 6, 40)).otherwise(F.sha1("content")).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        number("warc-refers-to").alias("refers_to"),
    )
