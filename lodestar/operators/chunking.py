"""Chunkers: sliding token window, recursive boundaries, parents with children.

Rows in, rows out: the input's columns ``id`` and ``text`` give a row for each
chunk. Null and blank texts have no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import SPACE, count_tokens
from lodestar.sources.extract import extracted

#: Separators of the recursive chunker, coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def window(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Array of (ordinal, content, token_count). Contents are spans of the text, with its own white space inside."""
    size = max(1, size)
    stride = size - min(overlap, size - 1)
    found = F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1))

    def chunks(tokens: Column) -> Column:
        n = F.size(tokens)
        last = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int"))

        def one(i: Column) -> Column:
            content = F.regexp_replace(F.array_join(F.slice(tokens, i * stride + 1, size), ""), rf"{SPACE}+$", "")
            return F.struct(i.alias("ordinal"), content.alias("content"), F.least(F.lit(size), n - i * stride).alias("token_count"))

        return F.transform(F.sequence(F.lit(0), last), one)

    # as a lambda's argument the tokens are found once a text, not once a chunk
    some = F.get(F.transform(F.array(found), chunks), F.lit(0))
    return F.when(text.rlike(r"\S"), some).otherwise(F.array().cast("array<struct<ordinal:int,content:string,token_count:int>>"))


def chunk_window(df: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 200, overlap: int = 40) -> DataFrame:
    return df.select(F.col(id_col), F.inline(window(F.col(text_col), size, overlap)))


_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")
_WHITE = " \t\n\x0b\f\r"


def _cuts(text: str, size: int, tokens: list[int]) -> list[tuple[int, int]]:
    """Spans of trimmed parts of at most ``size`` tokens, cut at the coarsest separator that helps.

    Tokens are found once: a part begins with a token, so those that it holds are the starts in its span.
    """
    out, todo = [], [(0, len(text), 0)]
    while todo:
        start, end, level = todo.pop()
        held = text[start:end]
        start, end = start + len(held) - len(held.lstrip(_WHITE)), end - len(held) + len(held.rstrip(_WHITE))
        if start >= end:
            continue
        if level == len(SEPARATORS) or bisect_left(tokens, end) - bisect_left(tokens, start) <= size:
            out.append((start, end))
            continue
        parts, at = [], start
        for part in text[start:end].split(SEPARATORS[level]):
            parts.append((at, at + len(part), level + 1))
            at += len(part) + len(SEPARATORS[level])
        todo += reversed(parts)
    return out


def recursive(text: str | None, size: int = 200, overlap: int = 40) -> list[dict]:
    """Pieces packed greedily up to ``size`` tokens; a chunk starts ``overlap`` tokens of whole pieces before the last one's end.

    Contents are spans of the text from the first piece to the last. Both ends of
    a chunk are places in the running sums of the pieces' tokens.
    """
    size = max(1, size)
    overlap = min(overlap, size - 1)
    tokens = [m.start() for m in _TOKEN.finditer(text or "")]
    pieces = _cuts(text or "", size, tokens)
    before = [0, *accumulate(bisect_left(tokens, end) - bisect_left(tokens, start) for start, end in pieces)]
    out, first = [], 0
    while first < len(pieces):
        last = max(first + 1, bisect_right(before, before[first] + size) - 1)
        out.append({"ordinal": len(out), "content": text[pieces[first][0] : pieces[last - 1][1]], "token_count": before[last] - before[first]})
        first = len(pieces) if last == len(pieces) else max(first + 1, bisect_left(before, before[last] - overlap))
    return out


def chunk_recursive(df: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 200, overlap: int = 40) -> DataFrame:
    @F.pandas_udf("array<struct<ordinal:int,content:string,token_count:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive(t, size, overlap))

    return df.select(F.col(id_col), F.inline(run(F.col(text_col))))


def chunk_parent_child(df: DataFrame, id_col: str = "id", text_col: str = "text", parent_size: int = 400, child_size: int = 100, child_overlap: int = 20) -> DataFrame:
    """A row for each child: parent_ordinal, parent_content, ordinal (counted over the whole document), content, token_count."""

    @F.pandas_udf("array<struct<ordinal:int,content:string,token_count:int>>")
    def parents(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive(t, parent_size, 0))

    nested = df.select(F.col(id_col), parents(F.col(text_col)).alias("parents"))
    children = F.transform("parents", lambda p: F.transform(window(p["content"], child_size, child_overlap), lambda c: F.struct(p["ordinal"].alias("parent_ordinal"), p["content"].alias("parent_content"), c["content"].alias("content"), c["token_count"].alias("token_count"))))
    flat = nested.select(F.col(id_col), F.posexplode(F.flatten(children)).alias("ordinal", "c"))
    return flat.select(F.col(id_col), "c.parent_ordinal", "c.parent_content", "ordinal", "c.content", "c.token_count")


def extract_and_chunk(df: DataFrame, id_col: str = "id", content_col: str = "content", fmt: str | None = None, size: int = 200, overlap: int = 40) -> DataFrame:
    """Bytes to text to window chunks; documents whose text can't be had give no chunks."""
    found = df.select(F.col(id_col), extracted(F.col(content_col), fmt=fmt).alias("x"))
    cut = found.filter("x.status = 'ok'").select(F.col(id_col), "x.format", "x.text")
    return cut.select(F.col(id_col), "format", F.inline(window(F.col("text"), size, overlap)))


def with_token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("token_count", count_tokens(F.col(text_col)))
