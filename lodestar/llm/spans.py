"""Positions of regular-expression matches, with DataFrame functions only.

``regexp_extract_all`` gives the matches of a text and ``split`` with the same
pattern the gaps between them, so a match starts after all gaps and matches
before it. Running sums are taken over short chunks and then over the chunks,
which keeps texts with very many matches from quadratic copying.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def _short_running(sums: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct((s["total"] + x).alias("total"), F.array_append(s["out"], s["total"]).alias("out"))
    return F.aggregate(sums, start, step, lambda s: s["out"])


def running(numbers: Column) -> Column:
    """For an array of longs the sum of what comes before each element."""
    last = F.floor((F.size(numbers) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(numbers, c * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
    inside = F.zip_with(chunks, _short_running(totals), lambda c, base: F.transform(_short_running(c), lambda x: x + base))
    return F.when(F.size(numbers) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p).cast("long"))


def starts(gaps: Column, matches: Column) -> Column:
    """First code point, from 0, of each match; gaps has one element more than matches."""
    steps = F.zip_with(F.slice(lengths(gaps), 1, F.size(matches)), F.concat(F.array(F.lit(0).cast("long")), lengths(matches)), lambda g, m: g + m)
    both = F.slice(steps, 1, F.size(matches))
    return F.zip_with(running(both), both, lambda before, own: before + own)
