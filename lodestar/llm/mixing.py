"""Mixing sources by temperature.

A source with a share p of all tokens gets a weight proportional to p ** a. The
exponent a, 1 for the mix as it is and 0 for equal weights, is bisected until
the weights' entropy reaches a target, or no source repeats more often than
allowed. A weight's part of the budget is realised as whole passes over the
source and a part of one more: the source's documents are dealt into blocks, the
part takes blocks in the order of a keyed hash until the budget is met, and
only the block in which this happens is looked at document by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import scratch

#: Tables with a row for each source are collected and broadcast up to this many; beyond it aggregates and shuffles do the work.
MOST_SOURCES = 200_000


@dataclass(frozen=True)
class Settings:
    """``entropy``: target as a part of the greatest possible. ``most_repeats``: passes allowed over a source. With
    both, both hold. ``budget``: tokens to realise; None for as many as there are, ``"cover"`` for the fewest with
    which each source is passed over whole once."""

    entropy: float | None = None
    most_repeats: float | None = None
    budget: int | str | None = None
    seed: int = 17
    block_docs: int = 1024


def words(text: Column) -> Column:
    """A cheap count of tokens: words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisect(holds: Callable[[float], bool], rounds: int = 50) -> float:
    """The smallest exponent in [0, 1] from which on ``holds`` is true; 1 if it never is."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent(totals: DataFrame, settings: Settings) -> tuple[float, float, float]:
    """Exponent, sum of all powers of shares, and budget. totals: (key, tokens, docs), tokens > 0."""
    n, all_tokens = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0, 1.0, 0.0
    if n <= MOST_SOURCES:
        shares = sorted(r.tokens / all_tokens for r in totals.select("tokens").collect())

        def sums(a: float) -> tuple[float, float, float, float]:
            powers = [p**a for p in shares]
            return math.fsum(powers), math.fsum(x * math.log(x) for x in powers), max(x / p for x, p in zip(powers, shares, strict=True)), min(x / p for x, p in zip(powers, shares, strict=True))
    else:
        share = totals.select((F.col("tokens") / F.lit(all_tokens)).alias("p"))

        def sums(a: float) -> tuple[float, float, float, float]:
            x = F.pow("p", F.lit(a))
            return tuple(share.agg(F.sum(x), F.sum(x * F.log(x)), F.max(x / F.col("p")), F.min(x / F.col("p"))).first())

    def budget(a: float) -> float:
        total, _, _, least = sums(a)
        if settings.budget == "cover":
            return all_tokens * total / least
        return float(all_tokens if settings.budget is None else settings.budget)

    def entropy(a: float) -> float:
        total, logs, _, _ = sums(a)
        return math.log(total) - logs / total

    a = 1.0 if settings.entropy is None and settings.most_repeats is None else 0.0
    if settings.entropy is not None:
        # entropy falls as the exponent grows: the largest exponent that still reaches the target
        goal = settings.entropy * math.log(n)
        a = 1.0 if entropy(1.0) >= goal else bisect(lambda x: entropy(x) < goal)
    if settings.most_repeats is not None:
        repeats = lambda x: sums(x)[2] / sums(x)[0] * budget(x) / all_tokens
        a = max(a, bisect(lambda x: repeats(x) <= settings.most_repeats * (1 + 1e-12)))
    return a, sums(a)[0], budget(a)


def plan(docs: DataFrame, settings: Settings = Settings(), tokens: Column | None = None) -> DataFrame:
    """``docs`` packed in a struct column ``row``, with tokens, weight, block and epochs: how often each row is taken, 0 included.

    A null source is a source of its own. A source without tokens has weight 0
    and is taken once. Rows with equal doc_id, tokens and text are taken alike.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    key = F.concat_ws("", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.lit("=")), F.col("source")).alias("key")
    base = docs.select(F.struct("*").alias("row"), key, tokens.alias("tokens"), F.xxhash64("doc_id", "text").alias("doc"))
    totals = scratch.table(base.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "source-totals")
    few = totals.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    used = totals.filter("tokens > 0")
    all_tokens = used.agg(F.sum("tokens")).first()[0] or 1
    a, total, budget = exponent(used, settings)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(all_tokens), F.lit(a)) / F.lit(total)).otherwise(F.lit(0.0))
    quota = F.floor(F.col("weight") * F.lit(budget) + 1e-6).cast("long")
    per_block = F.greatest(F.lit(settings.block_docs), F.floor(F.sqrt("docs")))
    quotas = totals.withColumn("weight", weight).withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("docs") / per_block).cast("int"))
    quotas = quotas.select("key", "weight", "blocks", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int").alias("passes"), F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest"))
    quotas = scratch.table(quotas, "quotas")

    block = F.pmod(F.xxhash64("doc", F.lit(settings.seed)), F.col("blocks")).cast("int")
    dealt = base.join(small(quotas.select("key", "weight", "blocks", "passes")), "key").withColumn("block", block)
    turn = F.xxhash64(F.lit(settings.seed), F.col("key"), F.col("block"))
    sizes = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("size")).withColumn("turn", turn)
    before = F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = sizes.withColumn("before", before).join(small(quotas.select("key", "rest")), "key").filter("before < rest and rest <= before + size")
    edge = scratch.table(edge.select("key", F.col("block").alias("edge"), F.col("turn").alias("edge_turn"), (F.col("rest") - F.col("before")).alias("left")), "edge-blocks")

    dealt = dealt.join(small(edge), "key", "left")
    inside = dealt.filter("block = edge").select("key", "doc", "tokens", "left").groupBy("key", "doc", "tokens", "left").agg(F.count("*").alias("copies"))
    order = W.partitionBy("key").orderBy(F.xxhash64("doc", F.lit(settings.seed + 1)), "doc", "tokens").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(order), F.lit(0))).filter("before < left")
    taken = scratch.table(inside.select("key", "doc", "tokens", F.lit(1).alias("taken")), "edge-documents")
    listed = taken.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    dealt = dealt.join(F.broadcast(taken) if listed else taken, ["key", "doc", "tokens"], "left")
    extra = F.when(F.col("edge").isNull(), 0).when(F.col("block") == F.col("edge"), F.coalesce("taken", F.lit(0))).otherwise(F.when(F.struct(turn.alias("t"), F.col("block").alias("b")) < F.struct(F.col("edge_turn").alias("t"), F.col("edge").alias("b")), 1).otherwise(0))
    return dealt.select("row", "tokens", "weight", "block", (F.col("passes") + extra).cast("int").alias("epochs"))


@scratch.settled("mixed")
def mix(docs: DataFrame, settings: Settings = Settings(), tokens: Column | None = None) -> DataFrame:
    """One row for each time that a document is taken: doc_id, source, tokens, weight, block, epoch from 0.

    A document beyond its source's budget has no row; the last one taken may
    pass the budget by a part of its length. See :func:`plan` for nulls, ties and
    repeated rows. Extra columns are not read. No rows in, no rows out.
    """
    planned = plan(docs.select("doc_id", "source", "text"), settings, tokens)
    return planned.filter("epochs > 0").select("row.doc_id", "row.source", "tokens", "weight", "block", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))


def mixed_documents(docs: DataFrame, settings: Settings = Settings(), tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as :func:`plan` takes it."""
    taken = plan(docs, settings, tokens).filter("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
