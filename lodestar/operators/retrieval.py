"""Exact vector, lexical and hybrid search over chunk tables.

``chunks`` has id, document_id, ordinal, content, embedding. Top-k is a sort
with a limit, which Spark runs as a bounded heap in each task; winners are
joined to their content afterwards, so a scan reads ids and vectors only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.text import like_contains
from lodestar.plans.config import Limits

#: Results of at most this many rows are collected to look up their content by id.
MOST_FOUND = 5000


def in_documents(chunks: DataFrame, document: str | None = None, documents: Sequence[str] | None = None) -> DataFrame:
    """One document wins over a list; neither, or an empty list, filters nothing."""
    if document:
        return chunks.filter(F.col("document_id") == document)
    return chunks.filter(F.col("document_id").isin(list(documents))) if documents else chunks


def nearest(table: DataFrame, query: Sequence[float], k: int = 10, metric: str = "euclidean", id_col: str = "id", vector_col: str = "embedding", same_length: bool = True) -> DataFrame:
    """(id, distance) of the k nearest; ties by id. Null, empty and, unless told otherwise, other-sized vectors are no candidates.

    A distance that is no number sorts last, so it is dropped after the cut, and
    each row's distance is computed once.
    """
    fits = F.size(vector_col) == len(query) if same_length else F.size(vector_col) > 0
    found = table.filter(fits).select(id_col, vectors.distance(F.col(vector_col), vectors.literal(list(query)), metric, same_length).alias("distance"))
    return found.orderBy(F.col("distance").asc_nulls_last(), id_col).limit(max(0, k)).filter(~F.isnan("distance"))


def hydrate(found: DataFrame, table: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Adds columns of ``table`` to a bounded result; an id that is gone keeps nulls.

    The result's rows are collected, if they are at most ``MOST_FOUND``, and their
    ids become a filter of the table's scan: of the table nothing else is moved.
    """
    rows = found.limit(MOST_FOUND + 1).collect()
    if len(rows) > MOST_FOUND:
        return found.join(table.select(id_col, *columns), id_col, "left")
    own = found.sparkSession.createDataFrame(rows, found.schema)
    wanted = table.filter(F.col(id_col).isin([r[id_col] for r in rows])).select(id_col, *columns)
    return own.join(wanted, id_col, "left")


def vector_search(chunks: DataFrame, query: Sequence[float], k: int = 10, metric: str = "euclidean", limits: Limits = Limits(), **docs) -> DataFrame:
    own = in_documents(chunks, **docs)
    return hydrate(nearest(own, query, limits.k(k), metric), own, ["document_id", "ordinal", "content"]).orderBy("distance", "id")


def entity_vector_search(table: DataFrame, query: Sequence[float], limit: int = 10, metric: str = "cosine") -> DataFrame:
    """Over id, entity_name, text_content, embedding; vectors may be shorter than the query and are compared over the shared length."""
    found = nearest(table, query, limit, metric, same_length=False)
    return hydrate(found, table, ["entity_name", "text_content"]).orderBy("distance", "id")


def lexical_search(chunks: DataFrame, query: str, k: int = 10, **docs) -> DataFrame:
    """Chunks that contain the query, shortest first; ties by id."""
    hits = in_documents(chunks, **docs).filter(like_contains(F.col("content"), query))
    return hits.select("id", "document_id", "ordinal", "content").orderBy(F.length("content"), "id").limit(max(0, k))


def reciprocal_rank_fusion(lists: Sequence[DataFrame], rrf_k: float = 60.0) -> DataFrame:
    """lists: (id, rank), rank from 1. Returns (id, score), best first, ties by id."""
    merged = lists[0].select("id", "rank")
    for other in lists[1:]:
        merged = merged.unionByName(other.select("id", "rank"))
    return merged.groupBy("id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id")


def mmr_order(relevance: np.ndarray, embeddings: np.ndarray, k: int, trade: float) -> list[int]:
    """Greedy maximal marginal relevance; similarity to what is chosen starts at 0, ties go to the first."""
    trade = min(1.0, max(0.0, trade))
    norms = np.sqrt((embeddings * embeddings).sum(1))
    unit = embeddings / np.where(norms > 0, norms, 1)[:, None]
    closest, chosen = np.zeros(len(relevance)), []
    left = np.ones(len(relevance), dtype=bool)
    while left.any() and len(chosen) < k:
        value = np.where(left, trade * relevance - (1 - trade) * closest, -np.inf)
        pick = int(value.argmax())
        chosen.append(pick)
        left[pick] = False
        closest = np.maximum(closest, np.nan_to_num(unit @ unit[pick]))
    return chosen


def mmr(candidates: DataFrame, k: int, trade: float = 0.5, group: str | None = None) -> DataFrame:
    """candidates: id, score, embedding, at most ``mmr_max_n`` a group. Adds position from 1; one group unless ``group`` names a column."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        order = mmr_order(rows["score"].to_numpy(float), np.array(rows["embedding"].tolist(), dtype=float), k, trade)
        return pd.DataFrame({"g": rows["g"].iloc[order], "id": rows["id"].iloc[order], "score": rows["score"].iloc[order], "position": range(1, len(order) + 1)})

    kind = candidates.schema["id"].dataType.simpleString()
    own = candidates.select((F.col(group) if group else F.lit("")).cast("string").alias("g"), "id", "score", "embedding")
    out = own.groupBy("g").applyInPandas(run, f"g string, id {kind}, score double, position int")
    return out if group else out.drop("g")


def hybrid_search(chunks: DataFrame, vector: Sequence[float] | None = None, query: str | None = None, k: int = 10, vec_k: int = 30, text_k: int = 30, metric: str = "euclidean", use_mmr: bool = False, trade: float = 0.5, rrf_k: float = 60.0, limits: Limits = Limits(), trace: Trace | None = None, **docs) -> DataFrame:
    """Vector and lexical arms fused by reciprocal ranks, re-ranked for diversity if asked and if there are few enough candidates.

    With a ``trace`` the stages (vector, lexical, fuse, rerank) run one by one and are timed.
    """
    step = trace.run if trace else lambda name, df: df
    if vector is None and not query:
        raise ValueError("a vector or a query is needed")
    own = in_documents(chunks, **docs)
    k, vec_k, text_k = limits.k(k), limits.candidates(vec_k), limits.candidates(text_k)
    arms = []
    if vector is not None:
        arms.append(step("vector", nearest(own, vector, vec_k, metric)).select("id", F.row_number().over(W.orderBy("distance", "id")).alias("rank")))
    if query:
        hits = step("lexical", lexical_search(own, query, text_k).select("id", F.length("content").alias("n")))
        arms.append(hits.select("id", F.row_number().over(W.orderBy("n", "id")).alias("rank")))
    fused = step("fuse", reciprocal_rank_fusion(arms, rrf_k))
    if use_mmr and vec_k + text_k <= limits.mmr_max_n:
        ranked = mmr(hydrate(fused, own, ["embedding"]), k, trade)
    else:
        ranked = fused.limit(k).withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    ranked = step("rerank", ranked)
    return hydrate(ranked, own, ["document_id", "ordinal", "content"]).orderBy("position")


class Trace:
    """Time and count of each stage of a search, in order."""

    def __init__(self, log: Callable[[str], None] | None = None):
        self.stages: list[dict] = []
        self._log = log

    def run(self, name: str, stage: DataFrame) -> DataFrame:
        """Runs a bounded stage and gives its rows to the next one."""
        began = time.perf_counter()
        rows = stage.collect()
        self.stages.append({"stage": name, "us": int(1e6 * (time.perf_counter() - began)), "count": len(rows)})
        if self._log:
            self._log(self.lines()[-1])
        return stage.sparkSession.createDataFrame(rows, stage.schema)

    def lines(self) -> list[str]:
        return [f"stage={s['stage']} us={s['us']} count={s['count']}" for s in self.stages]


def traced(name: str, search: DataFrame, log=print) -> tuple[list, dict]:
    """Runs a bounded search and reports its time and count."""
    trace = Trace(log)
    return trace.run(name, search).collect(), trace.stages[0]


def _nearest_rows(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[tuple[list[float], list]]:
    """For each row of ``q`` the distances and ids of its k nearest rows of ``x``; ties by id.

    A matrix product finds candidates, with room for its rounding; these are
    then measured one by one, so that equal vectors are equally far.
    """
    if metric == "cosine":
        x, q = (v / np.where((n := np.sqrt((v * v).sum(1))) > 0, n, 1)[:, None] for v in (x, q))
        rough = 1 - q @ x.T
    else:
        rough = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
    slack = 1e-9 * (1 + (0 if metric == "cosine" else (x * x).sum(1).max(initial=0) + (q * q).sum(1)[:, None]))
    limit = (np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.inf) + slack * np.ones((len(q), 1))
    for own, near in zip(q, rough <= limit, strict=True):
        at = np.flatnonzero(near)
        apart = x[at] * own if metric == "cosine" else (x[at] - own) ** 2
        d = 1 - apart.sum(1) if metric == "cosine" else np.sqrt(apart.sum(1))
        best = sorted(zip(d.tolist(), ids[at].tolist(), strict=True))[:k]
        yield [d for d, _ in best], [i for _, i in best]


def batch_nearest(table: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", block: int = 256, most_queries: int = 20_000) -> DataFrame:
    """For each row of ``queries`` (query_id, query_vector; at most ``most_queries``) its k nearest of ``table`` (id, embedding).

    Blocks of queries meet every row of the table as matrix products; each task
    keeps k rows a query over all that it reads, and the tasks' rows are merged by
    rank, ties by id. Only finite vectors of one length meet; a zero vector is at
    a cosine distance of 1 from all. Queries without a vector have no rows.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, distance double"
    rows = queries.filter("size(query_vector) > 0").orderBy("query_id").limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries; send them in parts")
    if not rows or k < 1:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.query_vector), []).append(r)
    blocks = [own[i : i + block] for own in by_length.values() for i in range(0, len(own), block)]

    def run(batches):
        held: dict[int, tuple[list[float], list]] = {}
        for pdf in batches:
            length = pdf["embedding"].map(len).to_numpy()
            for number, part in enumerate(blocks):
                own = pdf[length == len(part[0].query_vector)]
                if not len(own):
                    continue
                x, q = np.array(own["embedding"].tolist(), dtype=float), np.array([r.query_vector for r in part], dtype=float)
                good = np.isfinite(x).all(1)
                for i, (d, ids) in enumerate(_nearest_rows(x[good], own["id"].to_numpy()[good], q, k, metric)):
                    before = held.get(number * block + i, ([], []))
                    best = sorted(zip([*before[0], *d], [*before[1], *ids], strict=True))[:k]
                    held[number * block + i] = [d for d, _ in best], [i for _, i in best]
        for place, (d, ids) in held.items():
            yield pd.DataFrame({"query_id": [blocks[place // block][place % block].query_id] * len(d), "id": ids, "distance": d})

    found = table.select("id", "embedding").filter("size(embedding) > 0").mapInPandas(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
