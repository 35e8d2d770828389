"""Secret scans: multipart credential linking.

Base patterns are reported wherever they match. A weak part, which alone may
well be harmless, is reported only next to its complement: a bare key next to
an identifier, an identifier next to a secret, an endpoint next to both. "Next
to" is an interval join in scopes of ``reach`` code points around each part,
dealt by row and stretch of text, so a row with very many parts is many keys.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch, spans

#: Base patterns, in the order in which ties are listed; least lengths are applied to the matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts.
CLIENT = r"""(?i)(?<![A-Za-z0-9_])(?:client_?id|access_?key_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%+-]*)?"

KINDS = ("assign", "access", "hex", "client", "key", "endpoint")
BASE, WEAK = KINDS[:3], KINDS[3:]
#: Cheap tests that any match of a pattern passes.
HINTS = {"access": lambda t: F.contains(t, F.lit("AKIA")), "endpoint": lambda t: F.contains(t, F.lit("://"))}
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CLIENT, KEY, ENDPOINT), strict=True))
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
LEAST_SECRET = 12
#: Rows with linked parts are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _matched(df: DataFrame, text: str) -> DataFrame:
    """Adds for each kind an array of (start, rank, end), where rank is the kind's place in KINDS."""
    for kind, pattern in PATTERNS.items():
        hit = F.col(text).rlike(pattern)
        if kind in HINTS:
            hit = HINTS[kind](F.col(text)) & hit
        df = df.withColumn(f"_{kind}_hit", F.when(hit, F.col(text)))
    none = F.array().cast(SPAN)
    columns = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        hit = F.col(f"_{kind}_hit")
        df = df.withColumn(f"_{kind}_all", F.regexp_extract_all(hit, F.lit(pattern), F.lit(0))).withColumn(f"_{kind}_gap", F.split(hit, pattern, -1))
        df = df.withColumn(f"_{kind}_at", spans.starts(F.col(f"_{kind}_gap"), F.col(f"_{kind}_all")))
        found = F.zip_with(f"_{kind}_at", f"_{kind}_all", lambda at, m: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end")))  # noqa: B023
        if kind == "assign":
            secret = F.transform(F.regexp_extract_all(hit, F.lit(pattern), F.lit(2)), F.length)
            found = F.filter(F.zip_with(found, secret, lambda s, n: F.when(n >= LEAST_SECRET, s)), lambda s: s.isNotNull())
        columns.append(F.when(hit.isNull(), none).otherwise(found.cast(SPAN)).alias(f"_{kind}"))
    return df.select(*(c for c in df.columns if not c.startswith("_") or c in ("_row", "_docs")), *columns)


def _parts(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    both = F.concat(*(F.col(f"_{k}") for k in kinds))
    return found.select("_row", F.explode(both).alias("s")).select("_row", F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"))


def _near(wanted: DataFrame, others: DataFrame, reach: int, how: str = "left_semi") -> DataFrame:
    """Rows of ``wanted`` with (or, for left_anti, without) one of ``others`` within ``reach``; both are dealt over the stretches that they cover."""
    width = max(2 * reach, 256)
    cover = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("stretch")
    w = wanted.select("_row", "start", "rank", "end", cover(F.col("start"), F.col("end")))
    o = others.select("_row", F.col("start").alias("o_start"), F.col("end").alias("o_end"), cover(F.greatest(F.lit(0), F.col("start") - reach), F.col("end") + reach)).distinct()
    close = (F.col("start") <= F.col("o_end") + reach) & (F.col("o_start") <= F.col("end") + reach)
    if reach == 0:
        close = (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
    met = w.join(o, (w._row == o._row) & (w.stretch == o.stretch) & close, "left_semi").select("_row", "start", "rank", "end").distinct()
    return met if how == "left_semi" else wanted.join(met, ["_row", "start", "rank", "end"], "left_anti")


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """(_row, linked): weak parts whose complement is near, in rows that have any."""
    held = found.filter(reduce(lambda a, b: a | b, (F.size(f"_{k}") > 0 for k in WEAK)))
    weak = _near(_parts(held, WEAK), _parts(held, BASE), 0, "left_anti")
    rank = KINDS.index
    of = lambda *kinds: weak.filter(F.col("rank").isin([rank(k) for k in kinds]))
    identifiers = _parts(held, ("access",)).union(of("client"))
    secrets = _parts(held, ("assign",)).union(of("key"))
    reported = _near(of("key"), identifiers, reach).union(_near(of("client"), secrets, reach)).union(_near(_near(of("endpoint"), identifiers, reach), secrets, reach))
    return reported.groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def _scanned(docs: DataFrame, reach: int, keep: bool) -> DataFrame:
    """doc columns (packed in _docs if kept), base (sorted spans), spans (base and linked, sorted)."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    row = [F.struct("*").alias("_docs")] if keep else [F.col("doc_id")]
    found = _matched(docs.select(*row, text, F.monotonically_increasing_id().alias("_row")), "text").drop("text")
    found = scratch.table(found, "secret-parts")
    linked = scratch.table(_linked(found, reach), "linked-parts")
    few = linked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = found.join(F.broadcast(linked) if few else linked, "_row", "left")
    base = F.array_sort(F.concat(*(F.col(f"_{k}") for k in BASE)))
    joined = joined.withColumn("base", base)
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))))


def _text_of(listed: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@scratch.settled("scanned")
def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end in code points, end exclusive, by start, then
    kind, then end. A null text is empty and has no spans; texts are searched
    whole. Equal spans of two kinds are both listed; a weak part that overlaps a
    base span is not a part of its own. Repeated rows and null ids are scanned
    each; extra columns are not read. No rows in, no rows out.
    """
    found = _scanned(docs.select("doc_id", "text"), reach, keep=False)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, reach: int = 200, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of its texts that spans cover replaced by ``mask``; n_chars, where there is one, follows.

    Texts without spans, null ones too, and all other columns stay as they are.
    """
    found = _scanned(docs, reach, keep=True)
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    join = lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.array_append(out, F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    text = F.col("_docs.text")
    found = found.withColumn("merged", F.when(F.size("spans") > 0, F.aggregate("spans", start, join)))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("merged", lambda s: s["end"]))
    pieces = F.zip_with(ends, "merged", lambda e, s: F.when(s.isNotNull(), F.concat(F.substring(text, (e + 1).cast("int"), (s["start"] - e).cast("int")), F.lit(mask))).otherwise(F.substring(text, (e + 1).cast("int"), F.length(text))))
    found = found.withColumn("new_text", F.when(F.col("merged").isNotNull(), F.array_join(pieces, "")).otherwise(text))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("new_text").alias(name)
        if name == "n_chars":
            return F.when(F.col("merged").isNotNull(), F.length("new_text").cast(docs.schema[name].dataType)).otherwise(F.col("_docs.n_chars")).alias(name)
        return F.col("_docs").getField(name).alias(name)

    return found.select(*(column(c) for c in docs.columns))
