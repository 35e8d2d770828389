"""Knowledge graph operators over entities (name, entity_type, observations) and relations (from_entity, relation_type, to_entity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import like_contains
from lodestar.plans import scratch

#: A frontier or page is broadcast up to this many names; beyond it it is joined by a shuffle.
BROADCAST_NAMES = 500_000


def direction(value: str | None) -> str:
    word = (value or "").lower()
    return "out" if word in ("out", "outgoing") else "in" if word in ("in", "incoming") else "both"


def entity_stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "entity_type")


def relation_stats(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "relation_type")


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    tagged = entities.select(F.lit(1).alias("e"), F.lit(0).alias("r")).union(relations.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("entity_count"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("relation_count"))


def degrees(relations: DataFrame, way: str = "both") -> DataFrame:
    """(name, degree) of every endpoint; a relation of a node to itself counts twice both ways."""
    ends = {"out": [F.col("from_entity")], "in": [F.col("to_entity")], "both": [F.col("from_entity"), F.col("to_entity")]}[direction(way)]
    return relations.select(F.explode(F.array(*ends)).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def degree(relations: DataFrame, name: str, way: str = "both") -> DataFrame:
    out, into = (F.sum((F.col(c) == name).cast("long")) for c in ("from_entity", "to_entity"))
    total = {"out": out, "in": into, "both": out + into}[direction(way)]
    return relations.agg(F.coalesce(total, F.lit(0)).cast("long").alias("degree"))


def page(df: DataFrame, limit: int | None = None, offset: int | None = None, order: Sequence[str] = ("name",)) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def search_relations(relations: DataFrame, from_entity: str | None = None, to_entity: str | None = None, relation_type: str | None = None) -> DataFrame:
    for name, value in (("from_entity", from_entity), ("to_entity", to_entity), ("relation_type", relation_type)):
        relations = relations.filter(F.col(name) == value) if value else relations
    return relations.select("from_entity", "relation_type", "to_entity").orderBy("from_entity", "to_entity", "relation_type")


def _names(df: DataFrame) -> DataFrame:
    names = df.select(F.col(df.columns[0]).alias("n")).distinct()
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def touching(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with either end in ``names`` (first column), each once."""
    own = _names(names)
    ends = [relations.join(own, relations[c] == own.n, "left_semi") for c in ("from_entity", "to_entity")]
    return ends[0].union(ends[1]).select("from_entity", "relation_type", "to_entity").distinct()


def read_graph(entities: DataFrame, relations: DataFrame, entity_type: str | None = None, limit: int | None = None, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of entities, and the relations that touch it. The page is found once and written."""
    own = scratch.keep(page(entities.filter(F.col("entity_type") == entity_type) if entity_type else entities, limit, offset), "page")
    return own, touching(relations, own.select("name"))


def search_nodes(entities: DataFrame, relations: DataFrame, query: str, entity_type: str | None = None, limit: int | None = None, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
    hits = entities.filter(like_contains(F.col("name"), query) | like_contains(F.col("entity_type"), query))
    return read_graph(hits, relations, entity_type, limit, offset)


def _asked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, asked string")


def open_nodes(entities: DataFrame, relations: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entities in the order asked for, repeated as asked; relations of all names, those of missing entities too."""
    asked = _asked(entities, names)
    own = entities.join(F.broadcast(asked), entities.name == asked.asked).orderBy("pos").drop("asked")
    return own, touching(relations, asked.select("asked"))


def neighbors(entities: DataFrame, relations: DataFrame, names: Sequence[str], way: str = "both") -> tuple[DataFrame, DataFrame]:
    """Relations that leave or enter the names, and the entities at both their ends."""
    asked = F.broadcast(_asked(entities, names).select("asked").distinct())
    sides = {"out": ["from_entity"], "in": ["to_entity"], "both": ["from_entity", "to_entity"]}[direction(way)]
    found = None
    for side in sides:
        part = relations.join(asked, relations[side] == asked.asked, "left_semi")
        found = part if found is None else found.union(part)
    found = found.select("from_entity", "relation_type", "to_entity").distinct()
    ends = found.select(F.explode(F.array("from_entity", "to_entity")).alias("end")).distinct()
    return entities.join(ends, entities.name == ends.end, "left_semi"), found


def fulltext(entities: DataFrame, observations: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entities whose name, type or observations contain the query; observations as JSON text."""
    shown = entities.select("name", "entity_type", F.to_json("observations").alias("observations"))
    own = shown.filter(like_contains(F.col("name"), query) | like_contains(F.col("entity_type"), query) | like_contains(F.col("observations"), query))
    hits = observations.filter(like_contains(F.col("content"), query))
    told = shown.join(hits, shown.name == hits.entity_name, "left_semi")
    return own.union(told).distinct().orderBy("name", "entity_type", "observations").limit(limit)


def _steps(relations: DataFrame, way: str) -> DataFrame:
    """(a, b) for each step that a walk may take; repeated relations are repeated steps."""
    out = relations.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"))
    back = relations.select(F.col("to_entity").alias("a"), F.col("from_entity").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction(way)].filter("a <> b")


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def adjacency(relations: DataFrame, path: str, way: str = "both", buckets: int = 64) -> DataFrame:
    """Steps written once, a folder for each bucket of where they start; searches from few names read their buckets only.

    A bucket's rows come from several tasks, so that a name with very many steps is no single task's work.
    """
    steps = _steps(relations, way).distinct().withColumn("bucket", _bucket(F.col("a"), buckets))
    steps.repartition("bucket", F.pmod(F.xxhash64("b"), F.lit(4))).write.partitionBy("bucket").parquet(path)
    return relations.sparkSession.read.schema("a string, b string, bucket int").parquet(path)


def bfs(relations: DataFrame, source: str, max_hops: int = 10, way: str = "both", target: str | None = None, steps: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """(name, depth, parent) of what ``source`` reaches, level by level; of several parents the least name. Ends early at ``target``.

    ``steps`` is what :func:`adjacency` wrote, with as many ``buckets``; without it every hop reads all relations.
    """
    spark = relations.sparkSession
    bucketed = steps is not None
    steps = scratch.keep(_steps(relations, way), "steps") if steps is None else steps
    seen = spark.createDataFrame([(source, 0, None)], "name string, depth int, parent string")
    frontier = seen
    for hop in range(1, max_hops + 1):
        own = frontier.select(F.col("name").alias("at"))
        small = own.limit(BROADCAST_NAMES + 1).count()
        if not small:
            break
        near = steps
        if bucketed and small < buckets:
            near = steps.filter(F.col("bucket").isin([r.k for r in own.select(_bucket(F.col("at"), buckets).alias("k")).distinct().collect()]))
        reached = near.join(F.broadcast(own) if small <= BROADCAST_NAMES else own, F.col("a") == F.col("at")).groupBy("b").agg(F.min("a").alias("parent"))
        new = reached.join(seen.select(F.col("name").alias("b")), "b", "left_anti").select(F.col("b").alias("name"), F.lit(hop).alias("depth"), "parent")
        frontier = scratch.keep(new, f"hop-{hop}")
        seen = seen.union(frontier)
        if target is not None and not frontier.filter(F.col("name") == target).isEmpty():
            break
    return seen


def shortest_path(relations: DataFrame, source: str, target: str, max_hops: int = 10, way: str = "both", allow_same: bool = False) -> list[str]:
    """Names from source to target; empty if there is no path, and, unless ``allow_same``, from a node to itself."""
    if source == target:
        return [source] if allow_same else []
    seen = scratch.keep(bfs(relations, source, max_hops, way, target), "seen")
    path, at = [], target
    while at is not None and len(path) <= max_hops:
        row = seen.filter(F.col("name") == at).select("parent").first()
        if row is None:
            return []
        path.append(at)
        at = row.parent
    return path[::-1]


def path_table(relations: DataFrame, source: str, target: str, max_hops: int = 10, way: str = "both") -> DataFrame:
    found = shortest_path(relations, source, target, max_hops, way)
    return relations.sparkSession.createDataFrame(list(enumerate(found)), "position int, name string")
