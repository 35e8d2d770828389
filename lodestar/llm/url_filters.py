"""URL filters by a temporal list join.

Dated list entries (an address is listed, an address is taken off) become
intervals in which an address is listed. A capture is held against the entries
that were active when it was fetched, those of its host, of the domains above
it, and of its path's prefixes.

Time is cut into slices; entries and captures are joined by address and slice,
so an address with very many captures or entries is many keys. All time after
the list's last entry is one slice, so how many slices there are depends on the list alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import scratch

SLICE = 30 * 86_400
#: Interval slices are broadcast up to this many (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SLICES = 100_000
#: An address is asked for often if it has more than one of this many parts of all questions (and more than this many).
MOST_OFTEN = 10_000


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a dot at its end; null if there is none."""
    raw = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(raw, r"\.+$", ""), F.lit(""))


def addresses(url: Column) -> Column:
    """What lists may hold of a URL: ``domain:`` of its host and all domains above, ``prefix:`` of host and path up to each segment."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat(F.lit("prefix:"), name, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")))
    prefixes = F.when(F.size(segments) > 0, prefixes).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: (address, listed, at). Returns (address, valid_from, valid_to) in which an address is listed, valid_to exclusive and null if open.

    Of several entries of an address at one time, being listed wins. Rows with a
    null are left out. Each slice of an address is ordered on its own; its last
    entry ends where the address's next slice begins.
    """
    clean = entries.select("address", F.col("at").cast("long").alias("at"), F.col("listed").cast("boolean").alias("listed")).dropna()
    clean = clean.groupBy("address", "at").agg(F.max("listed").alias("listed")).withColumn("slice", F.floor(F.col("at") / SLICE))
    first = clean.groupBy("address", "slice").agg(F.min("at").alias("first"))
    later = first.select("address", "slice", F.lead("first").over(W.partitionBy("address").orderBy("slice")).alias("later"))
    within = clean.withColumn("next", F.lead("at").over(W.partitionBy("address", "slice").orderBy("at")))
    joined = within.join(later, ["address", "slice"])
    return joined.filter("listed").select("address", F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


@scratch.settled("evaluated")
def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row for each row of ``captures``: its id, fetched_at, n_entries (active addresses that match), blocked.

    Times are seconds. Null URLs, URLs without a host and captures without a time
    match nothing. Repeated rows and null ids are evaluated each; extra columns
    are not read. An address is counted once, however often it is listed. Any
    time that is a long will do, however far off. No rows in, no rows out.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).cast("long").alias("at"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows, "captures")
    listed = scratch.table(intervals(entries), "intervals")
    newest = listed.agg(F.greatest(F.max("valid_from"), F.coalesce(F.max("valid_to"), F.max("valid_from")))).first()[0]
    last = (newest or 0) // SLICE + 1
    slice_of = lambda at: F.least(F.floor(at / SLICE), F.lit(last))
    until = F.when(F.col("valid_to").isNull(), F.lit(last)).otherwise(slice_of(F.col("valid_to") - 1))
    cut = listed.withColumn("slice", F.explode(F.sequence(slice_of(F.col("valid_from")), until)))
    cut = scratch.table(cut, "interval-slices")
    few = cut.limit(BROADCAST_SLICES + 1).count() <= BROADCAST_SLICES
    asked = rows.select("row", "at", slice_of(F.col("at")).alias("slice"), F.explode(addresses(F.col("url"))).alias("address"))
    during = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = (asked.join(F.broadcast(cut), ["address", "slice"]) if few else _met_by_shuffle(asked, cut)).filter(during)
    counts = met.groupBy("row").agg(F.count("*").alias("n"))
    out = rows.join(counts, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("at").alias("fetched_at"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.col("n").isNotNull().alias("blocked"))


def _met_by_shuffle(asked: DataFrame, cut: DataFrame) -> DataFrame:
    """Of many slices: those of addresses that very many captures ask for, such as a top-level domain, meet them apart from the shuffle if they are few."""
    total = asked.count()
    often = asked.groupBy("address").count().filter(F.col("count") > max(MOST_OFTEN, total // MOST_OFTEN)).select("address")
    often = F.broadcast(scratch.table(often, "often-asked"))  # fewer than MOST_OFTEN
    theirs = cut.join(often, "address", "left_semi")
    theirs = F.broadcast(theirs) if theirs.limit(BROADCAST_SLICES + 1).count() <= BROADCAST_SLICES else theirs
    hot = asked.join(often, "address", "left_semi").join(theirs, ["address", "slice"])
    return hot.unionByName(asked.join(often, "address", "left_anti").join(cut, ["address", "slice"]))
