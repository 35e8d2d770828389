"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of ``coordinates`` minima. It is
posted under each (coordinate, value) pair. Two sets whose similarity reaches
the threshold agree in at least ``least_matches`` coordinates (up to a miss
probability of ``miss`` at the threshold itself), so in any common order of the
pairs they meet within the first ``coordinates - least_matches + 1`` of each:
only these prefixes are merged, rarest pairs first, and sets that share too few
pairs with anyone are skipped. Collisions are counted over the whole signatures,
pairs above the match threshold are confirmed on full shingle sets.

What is asked for is the component of each document, so links inside one
component need no check. Posting lists are therefore merged in two rounds: each
member against its list's first member, then only members of different
components against one another. Long lists take the second round in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bytetext, scratch
from lodestar.llm.components import components

#: Ids are broadcast up to this many (16 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Arrow batches of texts and shingle sets; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """``similarity_pct`` and ``shingle`` define a link; the others only its search.

    ``short_list``: longest posting list whose members are paired by a join.
    ``block``: members of a longer list that one task compares with as many.
    """

    similarity_pct: int = 80
    shingle: int = 5
    coordinates: int = 32
    miss: float = 1e-5
    short_list: int = 64
    block: int = 512

    @property
    def least_matches(self) -> int:
        p, n = self.similarity_pct / 100, self.coordinates
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
            if below > self.miss:
                return max(1, m)
        return n


def _name(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = bytetext.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return a, bytetext.mix(a)


def signature(members: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Minima of ``n`` hash functions over consecutive non-empty sets; ``starts`` are their first positions."""
    out = np.empty((len(starts), n), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(*_coefficients(n), strict=True)):
        out[:, k] = np.minimum.reduceat(members * a + b, starts) >> np.uint64(32)
    return out


def _sign(settings: Settings, id_type: pa.DataType):
    shape, n = settings.shingle, settings.coordinates

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids, column = batch.column(0).cast(id_type), batch.column(1)
            for first, last, texts in bytetext.batches(column):
                sets = list(bytetext.shingle_sets(texts, shape))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                names, signs = [None] * len(sets), [None] * len(sets)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    minima = signature(np.concatenate(sets), starts, n).view(np.int32)
                    for row, i in zip(minima, full, strict=True):
                        names[i] = _name(sets[i].tobytes())
                        signs[i] = row
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_id", "sig"])

    return run


def _full_sets(shape: int, id_type: pa.DataType):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids, column = batch.column(0).cast(id_type), batch.column(1)
            for first, last, texts in bytetext.batches(column):
                sets = [s.tobytes() for s in bytetext.shingle_sets(texts, shape)]
                names = [_name(s) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["rep", "set_id", "members"])

    return run


def similar(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """``100 * |a & b| >= pct * |a | b|`` for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < pct * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= pct * (len(a) + len(b) - both)


def _confirm(pct: int):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            x, y = batch.column("x_members"), batch.column("y_members")
            keep = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), pct) for a, b in zip(x, y, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections, through the members that occur more than once; ``cells`` bounds a dense piece."""
    both = a + b
    _, where, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    column = np.cumsum(times > 1) - 1
    keep = times[where] > 1
    owner, column = owner[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    width = max(1, cells // len(both))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(both), width), dtype=np.float32)
        dense[owner[i:j], column[i:j] - low] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out


def _open_pairs(data: pa.Table, rows: np.ndarray, cols: np.ndarray, least: int) -> np.ndarray:
    """Which members of two blocks, of different components, collide in at least ``least`` coordinates."""
    comp = np.asarray(data["component"])
    signs = np.array(data["sig"].to_pylist(), dtype=np.int32)
    matches = np.zeros((len(rows), len(cols)), dtype=np.int16)
    for k in range(signs.shape[1]):
        matches += signs[rows, k][:, None] == signs[cols, k][None, :]
    return (matches >= least) & (comp[rows][:, None] != comp[cols][None, :])


def _sides(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = np.asarray(data["side"])
    return np.flatnonzero(side <= 0), np.flatnonzero((side > 0) | (side == -1))


def _open_members(settings: Settings):
    """Of two blocks of a long list the members with an open pair: only their full sets are needed."""

    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        rows, cols = _sides(data)
        found = _open_pairs(data, rows, cols, settings.least_matches) if len(data) else np.zeros((0, 0), bool)
        return data.take(np.union1d(rows[found.any(1)], cols[found.any(0)]))

    return run


def _block(settings: Settings):
    """Two blocks of a long list: links between members of different components, one for each two groups that a link joins."""
    pct = settings.similarity_pct

    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        rep, comp, members = np.asarray(data["rep"]), np.asarray(data["component"]), data["members"]
        group = {int(c): int(c) for c in set(comp.tolist())}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        found_x, found_y = [], []
        r, c = _sides(data)
        if len(r) and len(c):
            full = lambda at: [np.frombuffer(members[int(i)].as_buffer(), np.uint64) for i in at]
            a, b = full(r), full(c)
            both = _intersections(a, b)
            size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
            linked = _open_pairs(data, r, c, settings.least_matches) & (100 * both >= pct * (size - both))
            for i, j in np.argwhere(linked):
                p, q = root(int(comp[r[i]])), root(int(comp[c[j]]))
                if p != q:
                    group[max(p, q)] = min(p, q)
                    found_x.append(rep[r[i]])
                    found_y.append(rep[c[j]])
        return pa.table({"x": pa.array(found_x, pa.int64()), "y": pa.array(found_y, pa.int64())})

    return run


def _within(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def _links(pairs: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """pairs: (x, y), x < y. Count collisions over the whole signatures, then confirm on full sets."""
    named = lambda p: members.select(*(F.col(c).alias(f"{p}_{c}") for c in ("rep", "sig", "members")))
    signs = lambda p: members.select(*(F.col(c).alias(f"{p}_{c}") for c in ("rep", "sig")))
    n = settings.coordinates
    collisions = reduce(add, ((F.col("x_sig")[k] == F.col("y_sig")[k]).cast("int") for k in range(n)))
    near = pairs.join(signs("x"), F.col("x") == F.col("x_rep")).join(signs("y"), F.col("y") == F.col("y_rep"))
    near = scratch.table(near.filter(collisions >= settings.least_matches).select("x", "y"), "near-pairs")
    full = near.join(named("x").drop("x_sig"), F.col("x") == F.col("x_rep")).join(named("y").drop("y_sig"), F.col("y") == F.col("y_rep"))
    return scratch.table(full.select("x", "y", "x_members", "y_members").mapInArrow(_confirm(settings.similarity_pct), "x long, y long"), "links", BATCH_BYTES)


@scratch.settled("near-duplicates")
def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, the document itself
    included; kept says that the document is that one. Null or empty texts and
    texts without words have n_shingles 0 and link with nothing. Long texts are
    taken whole. Rows with equal sets, repeated rows included, form one class; of an id that
    occurs with several texts each row gets the component of its own text, or of
    all that the id leads, and only as many rows as it has. A null id can neither lead nor join a component: its
    component_id is null and kept false. Extra columns are not read. No rows in,
    no rows out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(base.mapInArrow(_sign(settings, pa.int64()), "doc_id long, n_shingles long, set_id binary, sig array<int>"), "signatures", BATCH_BYTES)
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = scratch.table(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    posts = reps.select("rep", F.posexplode("sig").alias("c", "v"), "set_id")
    shared = posts.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    least, total = settings.least_matches, settings.coordinates
    held = posts.join(shared, ["c", "v"]).groupBy("set_id", "rep").agg(F.array_sort(F.collect_list(F.struct("n", "c", "v"))).alias("p"))
    prefix = held.filter(F.size("p") >= least).select("set_id", "rep", F.inline(F.expr(f"slice(p, 1, size(p) - {least} + 1)")))
    prefix = scratch.table(prefix, "prefixes")

    wanted = scratch.table(prefix.select("rep").distinct(), "wanted")
    one_each = _within(base.filter("doc_id is not null"), wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = one_each.mapInArrow(_full_sets(settings.shingle, pa.int64()), "rep long, set_id binary, members binary")
    sets = sets.groupBy("rep", "set_id").agg(F.first("members").alias("members"))
    members = scratch.table(reps.join(sets, ["rep", "set_id"]), "members", BATCH_BYTES)

    heads = prefix.groupBy("c", "v").agg(F.min("rep").alias("x"))
    stars = prefix.join(heads, ["c", "v"]).select("x", F.col("rep").alias("y")).filter("x < y").distinct()
    links = _links(stars, members, settings)
    found = scratch.table(components(links, "x", "y"), "first-components")

    placed = prefix.join(found, prefix.rep == found.node, "left").select("c", "v", "n", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("c", "v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high")
    placed = scratch.table(placed.join(mixed, ["c", "v"]).select("c", "v", "size", "rep", "component"), "open-lists")
    short = placed.filter(F.col("size") <= settings.short_list)
    left, right = (short.select("c", "v", F.col("rep").alias(x), F.col("component").alias(f"{x}c")) for x in "xy")
    pairs = left.join(right, ["c", "v"]).filter("x < y and xc <> yc").select("x", "y").distinct()
    links = links.union(_links(pairs, members, settings)).union(_long_links(placed.filter(F.col("size") > settings.short_list), members, settings))

    joined = components(links, "x", "y")
    classes = reps.join(joined, reps.rep == joined.node, "left").select("set_id", F.coalesce("component", "rep").alias("class"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


def _long_links(placed: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Every two blocks of each long list meet in one task of at most 2 * ``block`` members: first by signatures, then those with open pairs by full sets."""
    blocks = F.ceil(F.col("size") / settings.block).cast("int")
    dealt = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    signs = members.select("rep", "sig")
    dealt = dealt.hint("merge").join(signs, "rep").select("c", "v", "rep", "component", "sig", "own", meets)
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("c", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep", "component", "sig")
    found = dealt.groupBy("c", "v", "i", "j").applyInArrow(_open_members(settings), dealt.schema)
    found = scratch.table(found, "open-members")
    full = found.hint("merge").join(members.select("rep", "members"), "rep")  # signatures are much larger than their file tells
    return full.groupBy("c", "v", "i", "j").applyInArrow(_block(settings), "x long, y long")
