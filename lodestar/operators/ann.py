"""Approximate search: an inverted file of k-means cells with exact re-ranking, and sign bits with exact re-ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestar.functions import vectors
from lodestar.operators.retrieval import nearest
from lodestar.plans import scratch


@dataclass(frozen=True)
class Index:
    """``celled`` is the whole table with a column ``cell``, stored a folder a cell; centroids were fitted on a bounded sample."""

    celled: DataFrame
    centroids: np.ndarray
    metric: str


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-30)


def _own_cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)


def build(table: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 12, metric: str = "euclidean", path: str | None = None) -> Index:
    """k-means on at most ``sample`` rows, by the least hash of their id; every row with a vector is then written to its cell's folder below ``path``.

    Searches read the folders of the cells that they probe and no others. A path
    that is written once can be opened by :func:`load`; without one the index
    lies in the shared folder.
    """
    fine = table.filter("size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    drawn = fine.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()
    x = np.array(drawn["embedding"].tolist(), dtype=float)
    x = _unit(x) if metric == "cosine" and len(x) else x
    centroids = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        own = _own_cells(x, centroids)
        centroids = np.array([x[own == k].mean(0) if (own == k).any() else centroids[k] for k in range(len(centroids))])

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        y = np.array(v.tolist(), dtype=float)
        return pd.Series(_own_cells(_unit(y) if metric == "cosine" else y, centroids))

    path = path or scratch.new_path(table.sparkSession, "index")
    placed = fine.filter(F.size("embedding") == centroids.shape[1]).withColumn("cell", cell("embedding")) if len(x) else table.limit(0).withColumn("cell", F.lit(0))
    placed.write.partitionBy("cell").parquet(f"{path}/cells")
    table.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return load(table.sparkSession, path, table.schema, metric)


def load(spark: SparkSession, path: str, schema: StructType, metric: str = "euclidean") -> Index:
    """An index that :func:`build` wrote; ``schema`` is that of the table."""
    rows = sorted(spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/centroids").collect())
    with_cell = StructType([*(f for f in schema if f.name != "cell"), StructField("cell", IntegerType())])
    return Index(spark.read.schema(with_cell).parquet(f"{path}/cells"), np.array([r.centroid for r in rows]), metric)


def search(index: Index, query: Sequence[float], k: int = 10, probes: int = 4) -> DataFrame:
    """The k nearest among the ``probes`` nearest cells; all cells give the exact answer."""
    q = np.array(query, dtype=float)
    if index.metric == "cosine":
        q = q / max(float(np.sqrt((q * q).sum())), 1e-30)
    near = ((index.centroids - q) ** 2).sum(1).argsort()[:probes].tolist() if len(index.centroids) else []
    return nearest(index.celled.filter(F.col("cell").isin(near)), query, k, index.metric)


def _in_cells(index: Index, asked: list, allowed: np.ndarray, k: int, schema: str) -> DataFrame:
    """Each task's k nearest of each query in the cells that it is allowed (queries by cells); ties by id."""
    cosine = index.metric == "cosine"
    vectors_asked = np.array([r.query_vector for r in asked], dtype=float)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, cell, ids = np.array(pdf["embedding"].tolist(), dtype=float), pdf["cell"].to_numpy(), pdf["id"].to_numpy()
            keep = (x * x).sum(1) > 0 if cosine else np.ones(len(x), dtype=bool)
            x = _unit(x) if cosine else x
            out = []
            for r, q, cells in zip(asked, vectors_asked, allowed, strict=True):
                at = np.flatnonzero(cells[cell] & keep)
                if not len(at) or (cosine and not q.any()):
                    continue
                apart = x[at] - (_unit(q) if cosine else q)
                d = np.einsum("ij,ij->i", apart, apart)
                d = d / 2 if cosine else np.sqrt(d)
                if len(at) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    at, d = at[near], d[near]
                out += [(r.query_id, i, e) for e, i in sorted(zip(d.tolist(), ids[at], strict=True))[:k]]
            yield pd.DataFrame(out, columns=["query_id", "id", "distance"])

    held = index.celled.filter(F.col("cell").isin(np.flatnonzero(allowed.any(0)).tolist()))
    return held.select("id", "embedding", "cell").mapInPandas(run, schema)


def search_batch(index: Index, queries: DataFrame, k: int = 10, probes: int = 4, most_queries: int = 20_000) -> DataFrame:
    """For each row of ``queries`` (query_id, query_vector; at most ``most_queries``) its exact k nearest: query_id, id, distance, rank.

    The ``probes`` nearest cells are searched first. A cell can hold a nearer
    vector only if the distance to its centroid less its radius is at most that
    of the k-th found; those that can are searched too.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), index.celled.schema["id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, distance double"
    asked = queries.orderBy("query_id").limit(most_queries + 1).collect()
    if len(asked) > most_queries:
        raise ValueError(f"more than {most_queries} queries; send them in parts")
    if not asked or not len(index.centroids) or k < 1:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    centroids, cosine = index.centroids, index.metric == "cosine"
    seen = np.array([r.query_vector for r in asked], dtype=float)
    seen = _unit(seen) if cosine else seen
    gap = np.sqrt(((seen[:, None] - centroids[None]) ** 2).sum(2))

    @F.pandas_udf("double")
    def from_centroid(v: pd.Series, cell: pd.Series) -> pd.Series:
        y = np.array(v.tolist(), dtype=float)
        return pd.Series(np.sqrt((((_unit(y) if cosine else y) - centroids[cell.to_numpy()]) ** 2).sum(1)))

    radius = np.full(len(centroids), -np.inf)
    for r in index.celled.groupBy("cell").agg(F.max(from_centroid("embedding", "cell")).alias("radius")).collect():
        radius[r.cell] = r.radius

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    best = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= k)
    probed = np.zeros(gap.shape, dtype=bool)
    np.put_along_axis(probed, gap.argsort(1)[:, :probes], True, 1)
    first = scratch.keep(best(_in_cells(index, asked, probed, k, schema)), "probed")
    last = {r.query_id: r.distance for r in first.filter(F.col("rank") == k).collect()}
    reach = np.array([last.get(r.query_id, np.inf) for r in asked])
    reach = np.sqrt(2 * reach) if cosine else reach
    slack = 1e-9 * (1 + gap)
    rest = ~probed & (gap - radius[None, :] <= reach[:, None] + slack)
    return best(first.drop("rank").union(_in_cells(index, asked, rest, k, schema))) if rest.any() else first


def binary_rerank(table: DataFrame, query: Sequence[float], k: int = 10, factor: int = 8, metric: str = "cosine", exact: bool = False) -> DataFrame:
    """The k nearest of the ``factor * k`` rows that differ from the query in the fewest signs.

    With ``exact``, the k nearest of all rows: of the others those are compared too
    whose signs allow them to be as near as the k-th found. Where signs differ, a
    product is no gain (cosine), and a difference at least the query's own value (euclidean).
    """
    bits = vectors.to_bits(F.col("embedding"))
    asked = vectors.to_bits(vectors.literal(list(query)))
    own = table.filter(F.size("embedding") == len(query)).withColumn("bits_apart", vectors.hamming(bits, asked))
    found = nearest(own.orderBy("bits_apart", "id").limit(factor * k), query, k, metric)
    if not exact:
        return found
    size = sum(float(x) * float(x) for x in query)
    n, kth = found.agg(F.count("*"), F.max("distance")).first()
    if n < k or not size or metric not in ("cosine", "euclidean"):
        return nearest(own, query, k, metric)
    lost = F.aggregate(F.zip_with("embedding", vectors.literal(list(query)), lambda a, b: F.when((a >= 0) != (b >= 0), b * b).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    most = kth * kth if metric == "euclidean" else size * (1 - max(0.0, 1 - kth) ** 2)
    return nearest(own.filter(lost <= most + 1e-9 * (size + most)), query, k, metric)
