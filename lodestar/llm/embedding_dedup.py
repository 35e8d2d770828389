"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least ``c`` is a distance of at most
``r = sqrt(2 - 2c)``. Pivots cut the space into the cells of their nearest
pivot. By the triangle inequality a vector ``x`` of cell ``p`` can be within
``r`` of one of cell ``q`` only if ``d(x, q) - d(x, p) <= 2r``; in flat space
its distance to the cells' border, ``(d(x, q)^2 - d(x, p)^2) / (2 d(p, q))``,
must be ``r`` or less too. Only then must it meet that cell. Cells are split
into blocks, written once, a row a block. Blocks meet in a join of that table
with itself which shuffles nothing: each task reads two parts of the table, so
disk grows with the input and not with the pairs of blocks. A task returns link
counts and a forest, never pairs. Equal vectors are one class, by SHA-256, which
meets others once and counts as often as it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import scratch
from lodestar.llm.components import components

#: Rounding of a single-precision product of unit vectors, generously; nearer pairs are judged in double precision.
DOUBT = 1e-4
#: The same of distances to pivots, of vectors in single precision.
ROUGH = 1e-3
#: Bytes of blocks that a task keeps decoded, and rows of links that it holds before it folds them.
KEPT_BYTES, HELD_ROWS = 128 << 20, 1 << 19
#: Bytes of pairs of blocks that are sent to Python at once.
PAIR_BYTES = 8 << 20
#: Bytes of a part of the blocks' table; there are ``PARTS`` of them as far as that allows, and never fewer than ``LEAST_PARTS``.
PART_BYTES, PARTS, LEAST_PARTS = (24 << 20, 64 << 20), 96, 8


@dataclass(frozen=True)
class Settings:
    """``cosine`` defines a link. ``block``: most vectors on one side of a product; there are about as many cells as blocks, ``most_pivots`` at most."""

    cosine: float = 0.9
    block: int = 2048
    most_pivots: int = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision.

    Powers of two bring the largest component near 1 first, which rounds nothing and keeps squares from over- and underflow.
    """
    x = x.astype(np.float64)
    if x.size:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(data: bytes | list[bytes], d: int, n: int) -> np.ndarray:
    """``n`` vectors of length ``d`` as :func:`_packed` wrote them, or in one piece as :func:`_blocked` did."""
    if isinstance(data, list):
        if any(len(v) != 4 * d for v in data):
            return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * d else np.float64).astype(np.float64) for v in data])
        data = b"".join(data)
    return np.frombuffer(data, np.float32 if len(data) == 4 * d * n else np.float64).reshape(n, d)


def _packed(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, in single precision where that loses nothing, and their digests; zeros have no sign."""
    for batch in incoming:
        v = batch.column("v")
        flat, ends = np.asarray(v.flatten(), dtype=np.float64) + 0.0, np.cumsum(np.asarray(v.value_lengths().fill_null(0)))
        with np.errstate(over="ignore", under="ignore"):
            single = flat.astype(np.float32)
        same = single == flat
        digests, found, start = [], [], 0
        for end, given in zip(ends.tolist(), np.asarray(v.is_valid()).tolist(), strict=True):
            digests.append(hashlib.sha256(flat[start:end]).digest() if given else None)
            found.append((single if same[start:end].all() else flat)[start:end].tobytes() if given else None)
            start = end
        lengths = pa.array([None if x is None else n for x, n in zip(found, np.asarray(v.value_lengths().fill_null(0)).tolist(), strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), lengths, pa.array(found, pa.binary())], ["vec_id", "digest", "d", "x"])


@dataclass(frozen=True)
class _Cells:
    """Pivots by the vectors' length; a length's cells are numbered from its ``first`` on."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]

    def reaches(self, x: np.ndarray, d: int, cell: int, others: np.ndarray, radius: float) -> np.ndarray:
        """Whether unit vectors ``x`` of a cell may be within the radius of a vector of one of the others; a row a vector, a column a cell."""
        home, to = self.pivots[d][cell - self.first[d]], self.pivots[d][others - self.first[d]]
        cosines, at_home = x @ to.T, (x @ home)[:, None]
        apart = np.sqrt(np.maximum(2 - 2 * to @ home, 0))[None, :]
        far = lambda c: np.sqrt(np.maximum(2 - 2 * c, 0))
        border = (at_home - cosines) / np.maximum(apart, 1e-12)
        return (far(cosines) - far(at_home) <= 2 * radius + ROUGH) & ((border <= radius + ROUGH) | (apart < ROUGH)) | (others == cell)[None, :]


def _assign(cells: _Cells):
    """Each vector's cell."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            lengths, x = np.asarray(batch.column("d")), batch.column("x")
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(lengths).tolist():
                for rows in np.array_split(at := np.flatnonzero(lengths == d), -(-len(at) // 2048)):
                    cell[rows] = cells.first[d] + (_unit(_matrix(x.take(pa.array(rows)).to_pylist(), d, len(rows))) @ cells.pivots[d].T).argmax(1)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return run


def _blocked(cells: _Cells, radius: float):
    """A block as one row, with the cells that its vectors must meet."""

    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        cell, d, n = data["cell"][0].as_py(), data["d"][0].as_py(), data.num_rows
        v = _matrix(data["x"].to_pylist(), d, n)
        others = cells.first[d] + np.arange(len(cells.pivots[d]))
        reach = np.zeros(len(others), dtype=bool)
        for low in range(0, n, 1024):
            reach |= cells.reaches(_unit(v[low : low + 1024]), d, cell, others, radius).any(0)
        ids, copies = (np.asarray(data[c]).astype(np.int64).tobytes() for c in ("class", "copies"))
        row = [key[0].as_py(), cell, d, others[reach].tolist(), ids, copies, v.tobytes()]
        return pa.table([pa.array([c], t) for c, t in zip(row, BLOCK_TYPES, strict=True)], BLOCK.replace(",", "").split()[::2])

    return run


BLOCK = "block long, cell int, d int, reach array<int>, ids binary, copies binary, v binary"
BLOCK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())


def _fold(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(id, n, least) of many products, once for each id: n summed, the links between ids and least ones as a forest."""
    ids, n, least = (np.concatenate(c) for c in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([ids, least]), return_inverse=True)
    u, v = at[: len(ids)], at[len(ids) :]
    total = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(total, u, n)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root == (up := root[root])).all():
            root = up
    keep = (total > 0) | (root != np.arange(len(nodes)))
    return nodes[keep], total[keep], nodes[root[keep]]


class _Block:
    """One side of a product."""

    def __init__(self, row: dict, side: str):
        self.cell, self.d = row["cell" + side], row["d" + side]
        self.ids, self.copies = (np.frombuffer(row[c + side], np.int64) for c in ("ids", "copies"))
        self.v = _matrix(row["v" + side], self.d, len(self.ids))
        self.single = _unit(self.v).astype(np.float32)

    def facing(self, other: _Block, cells: _Cells, radius: float) -> np.ndarray:
        """The vectors that must meet the other's cell."""
        if other.cell == self.cell:
            return np.arange(len(self.ids))
        return np.flatnonzero(cells.reaches(self.single, self.d, self.cell, np.array([other.cell]), radius)[:, 0])


def _product(a: _Block, b: _Block, same: bool, cells: _Cells, cosine: float, radius: float) -> list[tuple[np.ndarray, ...]]:
    p, q = a.facing(b, cells, radius), b.facing(a, cells, radius)
    cosines = (a.single if len(p) == len(a.ids) else a.single[p]) @ (b.single if len(q) == len(b.ids) else b.single[q]).T
    doubt = max(DOUBT, 1e-7 * (a.d + 8))
    near = np.flatnonzero(cosines >= cosine - doubt)
    if not len(near) or same and len(near) == len(p):
        return []
    close = cosines >= cosine + doubt
    doubtful = near[cosines.ravel()[near] < cosine + doubt]
    for low in range(0, len(doubtful), 1 << 14):
        r, c = np.divmod(doubtful[low : low + (1 << 14)], len(q))
        close[r, c] = (_unit(a.v[p[r]]) * _unit(b.v[q[c]])).sum(1) >= cosine
    if same:
        np.fill_diagonal(close, False)
    rows, cols = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    if not len(rows):
        return []
    close, p, q = close[np.ix_(rows, cols)], p[rows], q[cols]
    of_a, of_b, top = a.ids[p], b.ids[q], np.iinfo(np.int64).max
    while True:
        before = of_a, of_b
        of_b = np.minimum(of_b, np.where(close, of_a[:, None], top).min(0))
        of_a = np.minimum(of_a, np.where(close, of_b[None, :], top).min(1))
        if (of_a == before[0]).all() and (of_b == before[1]).all():
            break
    found = [(a.ids[p], close @ b.copies[q], of_a)]
    return found if same else [*found, (b.ids[q], a.copies[p] @ close, of_b)]


def _meet(cells: _Cells, cosine: float, radius: float):
    """Products of pairs of blocks; what a task found is returned once for each vector."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Block] = {}
        found: list[tuple[np.ndarray, ...]] = []
        held = size = 0
        for batch in incoming:
            for k in range(batch.num_rows):
                sides = []
                for side in ("", "_2"):
                    block = batch.column("block" + side)[k].as_py()
                    if block not in kept:
                        if size > KEPT_BYTES:
                            kept, size = {}, 0
                        names = [c + side for c in ("cell", "d", "ids", "copies", "v")]
                        kept[block] = _Block({c: batch.column(c)[k].as_py() for c in names}, side)
                        size += kept[block].single.nbytes + kept[block].v.nbytes
                    sides.append((block, kept[block]))
                (i, a), (j, b) = sides
                now = _product(a, b, i == j, cells, cosine, radius)
                found, held = found + now, held + sum(len(x[0]) for x in now)
                if held > HELD_ROWS:
                    found = [_fold(found)]
                    held = min(len(found[0][0]), HELD_ROWS // 2)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _fold(found)], ["class", "n", "least"])

    return run


def _cells(rows: DataFrame, settings: Settings) -> _Cells:
    """Pivots are the vectors of the least digests."""
    known = rows.filter("digest is not null").select("d", "digest").distinct()
    pivots, first, at = {}, {}, 0
    for r in known.groupBy("d").count().orderBy("d").collect():
        wanted = int(min(settings.most_pivots, max(1, -(-r["count"] // settings.block))))
        chosen = rows.sparkSession.createDataFrame(known.filter(F.col("d") == r.d).orderBy("digest").limit(wanted).select("digest").collect(), "digest binary")
        found = rows.join(F.broadcast(chosen), "digest").groupBy("digest").agg(F.first("x").alias("x")).orderBy("digest").collect()
        pivots[r.d], first[r.d] = _unit(_matrix([bytes(f.x) for f in found], r.d, len(found))), at
        at += len(found)
    return _Cells(pivots, first)


def _links(classes: DataFrame, cells: _Cells, settings: Settings) -> DataFrame:
    """classes: (class, x, d, cell, copies), x distinct; returns (class, n, least), n with copies, and a forest of the links; a class may come from several tasks."""
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * settings.cosine))
    table, n, size = [], 0, 0
    for r in classes.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("size")).orderBy("cell").collect():
        table.append((r.cell, n, -(-r.n // settings.block)))
        n, size = n + table[-1][2], size + r.size
    numbered = spark.createDataFrame(table, "cell int, first long, blocks int")
    dealt = classes.join(F.broadcast(numbered), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")))
    parts = max(LEAST_PARTS, -(-size // min(max(size // PARTS, PART_BYTES[0]), PART_BYTES[1])))
    dealt = dealt.select("class", "x", "d", "cell", "copies", "block").repartition(parts, "block")
    left = scratch.table(dealt.groupBy("block").applyInArrow(_blocked(cells, radius), BLOCK), "vector-blocks")
    right = left.select(*(F.col(c).alias(c + "_2") for c in left.columns))
    i, j = F.col("block"), F.col("block_2")
    once = (i == j) | ((i != j) & ((i < j) == ((i + j) % 2 == 0)))
    pairs = left.crossJoin(right).filter(once & F.array_contains("reach", F.col("cell_2")) & F.array_contains("reach_2", F.col("cell")))
    columns = [c + side for side in ("", "_2") for c in ("block", "cell", "d", "ids", "copies", "v")]
    return pairs.select(*columns).mapInArrow(_meet(cells, settings.cosine, radius), "class long, n long, least long")


@scratch.settled("near-duplicates")
def near_duplicates(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or have a null or non-finite component link
    with nothing, nor do vectors of different length; components may be as large or
    small as doubles get. Rows are compared, and reported by id: a vec_id that
    occurs with several vectors is several vectors, each with its own links, and
    a row that repeats id and vector is the same vector again, with the same result.
    component_id is the smallest vec_id of any vector reached. A null vec_id has
    n_links 0, a null component_id and kept false, and no vector links with it.
    Columns other than vec_id and embedding are not read. No rows in, no rows out.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.expr("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)")
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    given = given.select("vec_id", F.when(F.col("vec_id").isNotNull() & usable, F.col("v")).alias("v"))
    spark = embeddings.sparkSession
    with scratch.collecting() as large:
        vectors = scratch.table(given.mapInArrow(_packed, "vec_id long, digest binary, d int, x binary"), "vectors")
    try:
        rows = scratch.table(vectors.select("vec_id", "digest"), "vector-rows")
        cells = _cells(vectors, settings)
        if not cells.pivots:
            return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
        known = rows.filter("digest is not null").distinct().groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
        distinct = vectors.filter("digest is not null").groupBy("digest").agg(F.first("x").alias("x"), F.first("d").alias("d")).join(known, "digest")
        classes = distinct.select(F.monotonically_increasing_id().alias("class"), "digest", "x", "d", "least_id", "copies")
        classes = scratch.table(classes.mapInArrow(_assign(cells), "class long, digest binary, x binary, d int, least_id long, copies long, cell int"), "vector-classes")
    finally:
        for path in large:
            scratch.drop(spark, path)
    found = scratch.settle(lambda: _links(classes, cells, settings), "vector-links", PAIR_BYTES)
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    reached = components(found, "class", "least").withColumnRenamed("node", "class")
    results = classes.select("class", "digest", "least_id", "copies").join(counts, "class", "left").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = results.groupBy("component").agg(F.min("least_id").alias("smallest"))
    results = results.join(smallest, "component").select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "smallest")
    out = rows.join(results, "digest", "left")
    own = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
