"""A store of tables as versions: each commit writes new folders and then one small file that names them.

A table is a list of steps: rows that were added, and keys whose rows among the
steps before are gone. So a write costs what it writes, not what is stored; once
a table has ``MOST_STEPS`` steps, the next write folds them into one. A version
is whole or absent: readers follow the file of the highest version. Of two
writers at once one fails. Paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.text import content_hash
from lodestar.plans import scratch
from lodestar.plans.config import Limits

DOCUMENT = "id string, uri string, title string, metadata string, chunk_count long, content_hash string, created_at timestamp, updated_at timestamp"
CHUNK = "id string, document_id string, ordinal long, content string, token_count long, embedding array<float>, created_at timestamp"
ENTITY = "name string, entity_type string, created_at timestamp"
OBSERVATION = "entity_name string, content string, created_at timestamp"
RELATION = "from_entity string, relation_type string, to_entity string, weight double, created_at timestamp"
VECTOR = "id string, entity_name string, text_content string, embedding array<float>, created_at timestamp"
#: Steps of a table before a write folds them, and keys that are broadcast where a table is read.
MOST_STEPS = 16
BROADCAST_KEYS = 200_000
TABLES = {"document": DOCUMENT, "chunk": CHUNK, "entity": ENTITY, "observation": OBSERVATION, "relation": RELATION, "vector": VECTOR}


def write(method: Callable) -> Callable:
    """A write of a restricted store fails before it looks at anything."""

    @wraps(method)
    def run(self, *args, **more):
        self.limits.may_write()
        return method(self, *args, **more)

    return run


class Store:
    def __init__(self, spark: SparkSession, path: str, limits: Limits = Limits()):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits
        jvm = spark._jvm.org.apache.hadoop.fs
        self._of = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._of(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._of(path), True)

    def _versions(self) -> list[int]:
        where = self._of(f"{self.path}/versions")
        if not self._fs.exists(where):
            return []
        return sorted(int(n.split(".")[0]) for n in (s.getPath().getName() for s in self._fs.listStatus(where)) if n.endswith(".json"))

    @property
    def version(self) -> int:
        return max(self._versions(), default=0)

    def _manifest(self, version: int | None = None) -> dict[str, list[dict]]:
        version = self.version if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._of(f"{self.path}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _schema(self, table: str) -> StructType:
        return self.spark.createDataFrame([], TABLES[table]).schema

    def read(self, table: str, version: int | None = None) -> DataFrame:
        schema, found, added = self._schema(table), None, []
        steps = self._manifest(version).get(table, [])
        for step in [*steps, None]:
            if step and "add" in step:
                added.append(step["add"])
                continue
            if added:
                rows = self.spark.read.schema(schema).parquet(*added)
                found, added = rows if found is None else found.unionByName(rows), []
            if step and found is not None:
                keys = self.spark.read.schema(StructType([schema[c] for c in step["on"]])).parquet(step["gone"])
                keys = F.broadcast(keys) if step["keys"] <= BROADCAST_KEYS else keys
                found = found.join(keys, step["on"], "left_anti").select(*schema.names)
        return self.spark.createDataFrame([], schema) if found is None else found

    @write
    def commit(self, add: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        """Rows to add, and before that keys (by their columns' names) whose stored rows go: all become visible with one rename, or none do."""
        number = self.version + 1
        manifest = self._manifest(number - 1)
        place = lambda table: f"{self.path}/data/{table}-{number:012d}-{uuid.uuid4().hex[:8]}"
        for table in {**(gone or {}), **(add or {})}:
            steps = manifest.setdefault(table, [])
            if len(steps) >= MOST_STEPS:
                self.read(table, number - 1).write.parquet(whole := place(table))
                steps = manifest[table] = [{"add": whole}]
            if steps and table in (gone or {}):
                gone[table].distinct().write.parquet(where := place(table))
                n = self.spark.read.schema(gone[table].schema).parquet(where).count()
                steps.append({"gone": where, "on": gone[table].columns, "keys": n})
            if table in (add or {}):
                add[table].select(*self._schema(table).names).write.parquet(where := place(table))
                steps.append({"add": where})
        draft, final = self._of(f"{self.path}/versions/{number:012d}.{uuid.uuid4().hex}.draft"), self._of(f"{self.path}/versions/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer was first")
        return number

    @write
    def vacuum(self, keep: int = 1) -> int:
        """Remove all versions but the last ``keep``, with the folders and indexes that only they use; returns how many folders went."""
        versions = self._versions()
        last = versions[-max(1, keep) :]
        used = {step.get("add") or step.get("gone") for v in last for steps in self._manifest(v).values() for step in steps}
        for v in versions[: -len(last)]:
            self.remove(f"{self.path}/versions/{v:012d}.json")
        n = 0
        for kind, stays in (("data", lambda name: f"{self.path}/data/{name}" in used), ("index", lambda name: int(name.split("-")[0]) in last)):
            where = self._of(f"{self.path}/{kind}")
            for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if not stays(s.getPath().getName()):
                    self._fs.delete(s.getPath(), True)
                    n += 1
        return n

    def _draft(self, df: DataFrame) -> DataFrame:
        """Rows that are read several times, written once, with one time of creation."""
        return scratch.keep(df, "draft")

    def _distinct(self, df: DataFrame, key: list[str], what: str) -> DataFrame:
        if not df.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{what} occurs twice")
        return df

    # documents and chunks

    @write
    def ingest(self, documents: DataFrame, chunks: DataFrame) -> dict[str, int]:
        """Upsert documents (id, uri, title, metadata) with their chunks (document_id, ordinal, content, embedding[, id, token_count]).

        A document whose content is as stored is skipped; the chunks of any other
        replace all that it had. An id of a document or chunk that occurs twice
        fails the batch.
        """
        now = F.current_timestamp()
        chunks = self._distinct(self._draft(with_chunk_defaults(chunks)), ["id"], "a chunk's id")
        told = F.concat_ws(":", F.lpad(F.col("ordinal").cast("string"), 12, "0"), content_hash(F.col("id"), F.col("content"), F.col("token_count"), F.col("embedding")))
        digest = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sha2(F.array_join(F.array_sort(F.collect_list(told)), ","), 256).alias("chunks_hash"))
        new = documents.join(digest, documents.id == digest.document_id, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))
        new = new.withColumn("content_hash", content_hash(F.col("id"), F.col("uri"), F.col("title"), F.col("metadata"), F.col("chunks_hash")))
        new = self._distinct(self._draft(new.select("id", "uri", "title", "metadata", "chunk_count", "content_hash")), ["id"], "a document's id")
        old = self.read("document").select("id", F.col("content_hash").alias("before"), F.col("created_at").alias("first"))
        rows = new.join(old, "id", "left").filter("before is null or before <> content_hash")
        rows = self._draft(rows.select(*new.columns, F.coalesce("first", now).alias("created_at"), now.alias("updated_at")))
        ids = rows.select(F.col("id").alias("document_id"))
        own = self._draft(chunks.join(ids, "document_id", "left_semi").withColumn("created_at", now))
        n, m = rows.count(), own.count()
        if n:
            self.commit({"document": rows, "chunk": own}, {"document": rows.select("id"), "chunk": ids})
        return {"documents": n, "chunks": m, "skipped": new.count() - n}

    @write
    def upsert_chunks(self, chunks: DataFrame) -> int:
        """Replace chunks by id, each once; their documents' hashes are cleared, so that sending a document again is not skipped."""
        own = self._distinct(self._draft(with_chunk_defaults(chunks).withColumn("created_at", F.current_timestamp())), ["id"], "a chunk's id")
        touched = own.select(F.col("document_id").alias("id")).distinct()
        cleared = self._draft(self.read("document").join(touched, "id", "left_semi").withColumn("content_hash", F.lit("")))
        self.commit({"chunk": own, "document": cleared}, {"chunk": own.select("id"), "document": cleared.select("id")})
        return own.count()

    @write
    def delete_documents(self, documents: list[str] | DataFrame) -> dict[str, int]:
        """Documents with their chunks; ``documents`` is a list of ids or a table of them in its first column."""
        ids = documents.select(F.col(documents.columns[0]).alias("id")).distinct() if isinstance(documents, DataFrame) else self.spark.createDataFrame([(d,) for d in documents], "id string")
        docs = ids.join(self.read("document"), "id", "left_semi")
        chunks = ids.select(F.col("id").alias("document_id"))
        counts = {"documents_deleted": docs.count(), "chunks_deleted": self.read("chunk").join(chunks, "document_id", "left_semi").count()}
        if any(counts.values()):
            self.commit(gone={"document": ids, "chunk": chunks})
        return counts

    def delete_document(self, document: str) -> dict[str, int]:
        return self.delete_documents([document])

    def get_document(self, document: str) -> DataFrame:
        return self.read("document").filter(F.col("id") == document)

    def list_documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.read("document").orderBy("id").offset(offset).limit(limit)

    def chunks_of(self, document: str) -> DataFrame:
        return self.read("chunk").filter(F.col("document_id") == document).orderBy("ordinal", "id")

    def stats(self) -> dict[str, int]:
        return {"document_count": self.read("document").count(), "chunk_count": self.read("chunk").count()}

    def counts(self) -> dict[str, int]:
        """Rows of every table."""
        return {table: self.read(table).count() for table in TABLES}

    # knowledge graph

    @write
    def create_entities(self, entities: DataFrame) -> int:
        """entities: name, entity_type, observations. One name twice, or a stored one, fails the whole batch."""
        now = F.current_timestamp()
        given = self._draft(entities.select("name", F.coalesce("entity_type", F.lit("")).alias("entity_type"), "observations", now.alias("created_at")))
        own = given.drop("observations")
        if not own.groupBy("name").count().filter("count > 1").isEmpty() or not own.join(self.read("entity"), "name", "left_semi").isEmpty():
            raise ValueError("an entity of this name exists")
        told = given.select(F.col("name").alias("entity_name"), F.explode("observations").alias("content"), "created_at")
        self.commit({"entity": own, "observation": told})
        return own.count()

    def entities(self) -> DataFrame:
        """name, entity_type, observations; observations are what the table holds now."""
        told = self.read("observation").groupBy("entity_name").agg(F.array_sort(F.collect_list("content")).alias("observations"))
        out = self.read("entity").join(told, F.col("name") == F.col("entity_name"), "left")
        return out.select("name", "entity_type", F.coalesce("observations", F.array().cast("array<string>")).alias("observations"))

    def has_observations(self, name: str) -> bool:
        return not self.read("observation").filter(F.col("entity_name") == name).isEmpty()

    @write
    def create_relations(self, relations: DataFrame) -> int:
        key = ["from_entity", "relation_type", "to_entity"]
        own = self._draft(relations.select(*key, F.lit(1.0).alias("weight"), F.current_timestamp().alias("created_at")))
        if not own.groupBy(*key).count().filter("count > 1").isEmpty() or not own.join(self.read("relation"), key, "left_semi").isEmpty():
            raise ValueError("a relation like this exists")
        self.commit({"relation": own})
        return own.count()

    @write
    def delete_entities(self, names: list[str], cascade: bool = False) -> int:
        """Entities; with ``cascade`` their observations, relations and vectors too, all in one commit."""
        asked = lambda column: self.spark.createDataFrame([(n,) for n in names], f"{column} string")
        n = self.read("entity").join(asked("name"), "name", "left_semi").count()
        gone = {"entity": asked("name")}
        if cascade:
            ends = F.col("from_entity").isin(names) | F.col("to_entity").isin(names)
            gone |= {"observation": asked("entity_name"), "vector": asked("entity_name"), "relation": self.read("relation").filter(ends).select("from_entity", "relation_type", "to_entity")}
        if names and (n or cascade):
            self.commit(gone=gone)
        return n

    @write
    def delete_relation(self, from_entity: str, relation_type: str, to_entity: str) -> int:
        key = self.spark.createDataFrame([(from_entity, relation_type, to_entity)], "from_entity string, relation_type string, to_entity string")
        return self._delete("relation", key)

    def _delete(self, table: str, keys: DataFrame) -> int:
        n = self.read(table).join(keys, keys.columns, "left_semi").count()
        if n:
            self.commit(gone={table: keys})
        return n

    @write
    def add_observations(self, name: str, contents: list[str]) -> int:
        if contents:
            self.commit({"observation": self.spark.createDataFrame([(name, c) for c in contents], "entity_name string, content string").withColumn("created_at", F.current_timestamp())})
        return len(contents)

    @write
    def delete_observations(self, name: str, contents: list[str]) -> int:
        return self._delete("observation", self.spark.createDataFrame([(name, c) for c in set(contents)], "entity_name string, content string")) if contents else 0

    @write
    def upsert_vectors(self, vectors: DataFrame) -> int:
        """Replace vectors by id; an id that occurs twice fails the batch."""
        own = self._distinct(self._draft(vectors.select("id", "entity_name", "text_content", "embedding", F.current_timestamp().alias("created_at"))), ["id"], "a vector's id")
        self.commit({"vector": own}, {"vector": own.select("id")})
        return own.count()

    def vectors_of(self, entity_name: str) -> DataFrame:
        """All vectors of an entity, by id."""
        return self.read("vector").filter(F.col("entity_name") == entity_name).orderBy("id")

    @write
    def delete_vectors(self, entity_name: str | None = None, id: str | None = None) -> int:
        return self._delete("vector", self.spark.createDataFrame([(entity_name or id,)], "entity_name string" if entity_name else "id string"))


def with_chunk_defaults(chunks: DataFrame) -> DataFrame:
    """id defaults to ``document#ordinal``, token_count to 0."""
    default = F.concat(F.col("document_id"), F.lit("#"), F.col("ordinal").cast("string"))
    chunks = chunks.withColumn("id", F.coalesce("id", default) if "id" in chunks.columns else default)
    return chunks.withColumn("token_count", F.coalesce("token_count", F.lit(0)).cast("long") if "token_count" in chunks.columns else F.lit(0).cast("long"))
