"""Connected components by alternating large-star and small-star steps.

Only joins and partial aggregates: a node with very many neighbours becomes a
key that is pre-aggregated before the shuffle, and a join that adaptive
execution can split. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Hang neighbours on the smallest of each neighbourhood."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    hung = near.join(least, near.u == least.k).select("u", "v", "m")
    if large:
        moved = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


@scratch.settled("components")
def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``links`` has node ids in columns ``a`` and ``b``; returns (node, component) with the smallest id of each component.

    Nodes without a link are not returned. Nulls and links of a node to itself
    are ignored; repeated links count once. An empty input gives no rows.
    """
    ids = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = scratch.table(ids.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sign(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = scratch.settle(lambda e=edges: _step(scratch.table(_step(e, True), "large-star"), False), "small-star")
        now = sign(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
