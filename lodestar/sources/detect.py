"""What format some bytes are in."""

from __future__ import annotations

import re

#: Formats, and the extensions that hint at them.
FORMATS = ("text", "markdown", "csv", "tsv", "json", "ndjson", "xml", "html", "docx", "pdf", "parquet", "arrow", "iceberg", "legacy_doc", "gzip", "unknown")
EXTRACTABLE = frozenset(FORMATS) - {"legacy_doc", "gzip", "unknown"}
EXTENSIONS = {".tsv": "tsv", ".csv": "csv", ".ndjson": "ndjson", ".jsonl": "ndjson", ".json": "json", ".md": "markdown", ".markdown": "markdown", ".xml": "xml", ".html": "html", ".htm": "html"}
WHITE = b" \t\n\r\x0b\x0c"


def _is_table_metadata(head: bytes) -> bool:
    return b'"format-version"' in head and (b'"table-uuid"' in head or b'"current-snapshot-id"' in head)


def _is_ndjson(head: bytes) -> bool:
    whole_lines = [x.strip(WHITE) for x in head.split(b"\n")[:-1]]
    lines = [x for x in whole_lines if x]
    return len(lines) >= 2 and all(x[:1] in b"{[" and x[-1:] in b"]}" for x in lines)


def _delimited(head: bytes) -> str | None:
    lines = [x for x in re.split(rb"\r?\n", head) if x.strip(WHITE)][:8]
    if len(lines) >= 2:
        for mark, name in ((b"\t", "tsv"), (b",", "csv")):
            counts = {x.count(mark) for x in lines}
            if len(counts) == 1 and counts != {0}:
                return name
    return None


def detect(data: bytes | None, filename: str | None = None) -> str:
    """Magic numbers first, then the first character, the extension, the look of a table; blank is unknown."""
    data = data or b""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(bytes.fromhex("d0cf11e0a1b11ae1")):
        return "legacy_doc"
    if data.startswith(b"\x1f\x8b"):
        return "gzip"
    if len(data) >= 12 and data.startswith(b"PAR1") and data.endswith(b"PAR1"):
        return "parquet"
    if data.startswith(b"ARROW1") and data.endswith(b"ARROW1") or data.startswith(b"\xff\xff\xff\xff"):
        return "arrow"
    if data.startswith(b"PK\x03\x04"):
        return "docx"
    body = data.removeprefix(b"\xef\xbb\xbf").lstrip(WHITE)
    if not body:
        return "unknown"
    if body[:1] in b"{[":
        if _is_table_metadata(data[:1024]):
            return "iceberg"
        return "ndjson" if _is_ndjson(data[:4096]) else "json"
    if body[:1] == b"<":
        return "html" if b"<html" in body[:256].lower() else "xml"
    name = (filename or "").lower()
    for ending, found in EXTENSIONS.items():
        if name.endswith(ending):
            return found
    return _delimited(data[:4096]) or "text"
