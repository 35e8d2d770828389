"""Text functions as Columns."""

from __future__ import annotations

import codecs
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters, which are exactly Java's ``\s``.
SPACE = r"[ \t\n\x0B\f\r]"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def count_tokens(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("int")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def like_contains(text: Column, query: str) -> Column:
    """``LIKE '%query%'`` with ASCII case folded only; ``%`` and ``_`` in the query stay wildcards and nothing escapes."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    if "%" not in folded and "_" not in folded:
        return F.contains(ascii_lower(text), F.lit(folded))
    return F.like(ascii_lower(text), F.lit("%" + folded.replace("~", "~~") + "%"), F.lit("~"))


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def utf8(data: bytes) -> str:
    """Each byte that is not part of well-formed UTF-8 becomes U+FFFD."""
    return data.decode("utf-8", "each-byte")


def replace_invalid_utf8(content: Column) -> Column:
    """Binary as text by the rule of :func:`utf8`."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else utf8(bytes(v)))

    return run(content.cast("binary"))


def content_hash(*columns: Column) -> Column:
    """A digest of values with their bounds: different rows of strings can't run together."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"f{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def is_json_number(text: Column) -> Column:
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def string_list(text: Column) -> Column:
    """JSON array text as strings; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def vector(text: Column) -> Column:
    """JSON array text as a vector; null if it isn't one."""
    return F.from_json(text, "array<float>")
