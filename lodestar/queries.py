"""The engine's own operators as queries over the test tables, with the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import format_queries  # noqa: F401  (its queries are registered when it is imported)
from lodestar.functions import vectors
from lodestar.functions.text import content_hash, count_tokens
from lodestar.operators import ann, chunking, graph, retrieval
from lodestar.plans import corpus, scratch
from lodestar.plans.catalog import Store
from lodestar.plans.config import Limits
from lodestar.plans.search import Searcher
from lodestar.registry import QUERIES, SQL, query
from lodestar.sources import extract
from lodestar.streaming.ingest import event_windows

__all__ = ["QUERIES", "SQL", "flagship"]

# SQL views of the data model

VEC = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"
L2 = "sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
COS = "list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(e, lambda z: z * z)) * list_sum(list_transform(q, lambda z: z * z)))"
TOKENS = r"regexp_extract_all(text, '[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*')"
CHUNKS = rf"""t AS (SELECT doc_id, {TOKENS} AS tok FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, tok, len(tok) AS n FROM t WHERE len(tok) > 0),
c AS (SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil((n - 40) / 160.0) AS BIGINT)))) AS ordinal, tok, n FROM n),
chunk AS (SELECT CAST(doc_id AS VARCHAR) || '#' || ordinal AS id, CAST(doc_id AS VARCHAR) AS document_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal,
          regexp_replace(array_to_string(tok[ordinal * 160 + 1 : ordinal * 160 + 200], ''), '[ \t\n\x0B\f\r]+$', '') AS content,
          CAST(least(200, n - ordinal * 160) AS INTEGER) AS token_count FROM c)"""
RELATIONS = """rel AS (
SELECT 'nation:' || n_nationkey AS f, 'in_region' AS r, 'region:' || n_regionkey AS t FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey FROM lineitem)"""
ENTITIES = """ent AS (
SELECT 'region:' || r_regionkey AS name, 'region' AS entity_type, r_name AS o FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_mktsegment FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part', p_brand FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus FROM orders)"""
WORD = "tion"


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 4) + F.lit(0.0))
    return df


@query(f"WITH {VEC} SELECT id, round({L2}, 4) AS distance FROM v, q ORDER BY {L2}, id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return _rounded(retrieval.nearest(_vectors(spark, sf_dir), corpus.query_vector(spark, sf_dir), 10), "distance")


@query(f"WITH {VEC} SELECT id, round(1 - {COS}, 4) + 0.0 AS distance FROM v, q ORDER BY 1 - {COS}, id LIMIT 10")
def vector_topk_cosine(spark, sf_dir):
    return _rounded(retrieval.nearest(_vectors(spark, sf_dir), corpus.query_vector(spark, sf_dir), 10, "cosine"), "distance")


@query(f"WITH {VEC} SELECT id, round({L2}, 4) AS distance FROM v, q WHERE label IN (1, 3) ORDER BY {L2}, id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    own = _vectors(spark, sf_dir).filter(F.col("label").isin(1, 3))
    return _rounded(retrieval.nearest(own, corpus.query_vector(spark, sf_dir), 10), "distance")


@query(f"WITH {VEC} SELECT id, 'label:' || label AS entity_name, 'vector ' || id AS text_content, round(1 - {COS}, 4) + 0.0 AS distance FROM v, q ORDER BY 1 - {COS}, id LIMIT 10")
def kg_vector_topk(spark, sf_dir):
    own = _vectors(spark, sf_dir).select("id", F.concat(F.lit("label:"), "label").alias("entity_name"), F.concat(F.lit("vector "), "id").alias("text_content"), "embedding")
    return _rounded(retrieval.entity_vector_search(own, corpus.query_vector(spark, sf_dir)), "distance")


@query(f"""WITH {VEC}, a AS (SELECT a.id AS query_id, b.id, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.e, lambda z: z * z)) * list_sum(list_transform(b.e, lambda z: z * z))) AS c
FROM v a JOIN v b ON true WHERE a.vec_id % 50 = 0)
SELECT query_id, id, round(1 - c, 4) + 0.0 AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 - c, 9), id) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""")
def batch_vector_topk(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    asked = own.filter(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = retrieval.batch_nearest(own, asked, 10)
    return _rounded(found, "distance")


@query(f"""WITH {VEC}, s AS (SELECT vec_id, id, e, q, list_max(list_transform(e, lambda z: abs(z))) / 127 AS se, list_max(list_transform(q, lambda z: abs(z))) / 127 AS sq FROM v, q),
i AS (SELECT id, list_transform(e, lambda z: round(z / se)) AS e, list_transform(q, lambda z: round(z / sq)) AS q FROM s)
SELECT id, round({COS}, 4) + 0.0 AS similarity FROM i ORDER BY {COS} DESC, id LIMIT 10""")
def int8_cosine_topk(spark, sf_dir):
    q = vectors.literal(corpus.query_vector(spark, sf_dir))
    codes = lambda v: vectors.to_int8(v, vectors.int8_scale(v))
    own = _vectors(spark, sf_dir).select("id", vectors.int8_cosine(codes(F.col("embedding")), codes(q)).alias("similarity"))
    return _rounded(own.orderBy(F.desc("similarity"), "id").limit(10), "similarity")


HAMMING = "CAST(list_sum(list_transform(list_zip(e, q), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END)) AS INTEGER)"


@query(f"WITH {VEC} SELECT id, {HAMMING} AS bits_apart FROM v, q ORDER BY 2, 1 LIMIT 20")
def hamming_topk(spark, sf_dir):
    q = vectors.to_bits(vectors.literal(corpus.query_vector(spark, sf_dir)))
    own = _vectors(spark, sf_dir).select("id", vectors.hamming(vectors.to_bits(F.col("embedding")), q).alias("bits_apart"))
    return own.orderBy("bits_apart", "id").limit(20)


@query(f"WITH {VEC}, n AS (SELECT id, e, q FROM v, q ORDER BY {HAMMING}, id LIMIT 80) SELECT id, round(1 - {COS}, 4) + 0.0 AS distance FROM n ORDER BY 1 - {COS}, id LIMIT 10")
def binary_rerank(spark, sf_dir):
    return _rounded(ann.binary_rerank(_vectors(spark, sf_dir), corpus.query_vector(spark, sf_dir)), "distance")


@query("SELECT 'f32' AS scheme, CAST(count(*) AS BIGINT) AS n, CAST(sum(5 + 4 * len(embedding)) AS BIGINT) AS bytes FROM embeddings UNION ALL SELECT 'f16', count(*), sum(5 + 2 * len(embedding)) FROM embeddings UNION ALL SELECT 'int8', count(*), sum(9 + len(embedding)) FROM embeddings UNION ALL SELECT 'binary', count(*), sum(5 + (len(embedding) + 7) // 8) FROM embeddings")
def quantised_sizes(spark, sf_dir):
    own, out = _vectors(spark, sf_dir), None
    for scheme in vectors.SCHEMES:
        part = own.select(F.length(vectors.encoded(F.col("embedding"), scheme)).cast("long").alias("b")).agg(F.lit(scheme).alias("scheme"), F.count("*").alias("n"), F.sum("b").alias("bytes"))
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {VEC}, a AS (SELECT a.id AS query_id, b.id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a JOIN v b ON true WHERE a.vec_id % 50 = 0)
SELECT query_id, id, round(d, 4) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""")
def ivf_topk(spark, sf_dir):
    """Approximate cells, exact answers: what the probed cells do not settle is searched too."""
    own = _vectors(spark, sf_dir).select("id", "embedding")
    asked = own.filter(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _rounded(ann.search_batch(ann.build(own, cells=8), asked, 10, probes=5), "distance")


@query(f"WITH {VEC} SELECT id, round({L2}, 4) AS distance FROM v, q ORDER BY {L2}, id LIMIT 10")
def vector_topk_guarded(spark, sf_dir):
    """Null, empty, short and non-finite vectors among the others are no candidates."""
    own = _vectors(spark, sf_dir).select("id", "embedding")
    odd = "null", "array()", "slice(embedding, 1, 3)", "transform(embedding, x -> float('nan'))"
    for i, e in enumerate(odd):
        own = own.union(_vectors(spark, sf_dir).select(F.concat(F.lit(f"odd{i}-"), "id"), F.expr(e).cast("array<float>")))
    return _rounded(retrieval.nearest(own, corpus.query_vector(spark, sf_dir), 10), "distance")


@query(f"WITH {VEC} SELECT 'f32' AS scheme, CAST(count(*) AS BIGINT) AS n, round(sum(list_sum(e)), 2) + 0.0 AS total FROM v UNION ALL SELECT 'binary', count(*), sum(list_sum(list_transform(e, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END))) FROM v")
def decoded_vectors(spark, sf_dir):
    own, out = _vectors(spark, sf_dir), None
    for scheme in ("f32", "binary"):
        back = vectors.decoded(vectors.encoded(F.col("embedding"), scheme))
        part = own.select(back.alias("e")).select(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("t")).agg(F.lit(scheme).alias("scheme"), F.count("*").alias("n"), (F.round(F.sum("t"), 2) + 0.0).alias("total"))
        out = part if out is None else out.union(part)
    return out


# chunks


@query(f"WITH {CHUNKS} SELECT id, document_id, ordinal, content, token_count FROM chunk")
def chunk_window(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).drop("doc_id")


@query(f"WITH {CHUNKS} SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunk")
def chunk_stats(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.sum(F.length("content")).alias("chars"))


@query(rf"SELECT doc_id, CAST(coalesce(len({TOKENS}), 0) AS INTEGER) AS token_count FROM documents")
def token_counts(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("token_count"))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_recursive(corpus.spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", 200, 40)


@query()
def chunk_parent_child(spark, sf_dir):
    return chunking.chunk_parent_child(corpus.spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


# lexical and hybrid search

LEXICAL = f"SELECT id, document_id, ordinal, content FROM chunk WHERE contains(lower(content), '{WORD}')"


@query(f"WITH {CHUNKS} {LEXICAL} ORDER BY length(content), id LIMIT 30")
def lexical_topk(spark, sf_dir):
    return retrieval.lexical_search(corpus.chunks(spark, sf_dir), WORD, 30)


@query(f"WITH {CHUNKS} {LEXICAL} AND document_id IN ('3', '5', '8') ORDER BY length(content), id LIMIT 30")
def lexical_topk_filtered(spark, sf_dir):
    return retrieval.lexical_search(corpus.chunks(spark, sf_dir), WORD, 30, documents=["3", "5", "8"])


def _hybrid(where: str = "true") -> str:
    return f"""WITH {CHUNKS}, {VEC}, k AS (SELECT count(*) AS k FROM embeddings),
w AS (SELECT chunk.*, e FROM chunk, k JOIN v ON v.vec_id = (chunk.doc_id * 31 + chunk.ordinal) % k WHERE {where}),
a AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, {L2} AS d FROM w, q ORDER BY d, id LIMIT 30)),
b AS (SELECT id, row_number() OVER (ORDER BY n, id) AS rank FROM (SELECT id, length(content) AS n FROM w WHERE contains(lower(content), '{WORD}') ORDER BY n, id LIMIT 30)),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 10)
SELECT id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS position, document_id, ordinal, content FROM f JOIN w USING (id)"""


def _searched(spark, sf_dir, **more) -> DataFrame:
    chunks = scratch.keep(corpus.embedded_chunks(spark, sf_dir), "embedded-chunks")
    found = retrieval.hybrid_search(chunks, corpus.query_vector(spark, sf_dir), WORD, **more)
    return _rounded(found, "score").select("id", "score", "position", "document_id", "ordinal", "content")


@query(_hybrid())
def rrf_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir)


@query(_hybrid("document_id IN ('1', '2', '4', '7', '9')"))
def hybrid_filtered(spark, sf_dir):
    return _searched(spark, sf_dir, documents=["1", "2", "4", "7", "9"])


#: Greedy choice by recursion: chosen places and each candidate's greatest similarity to them.
MMR = _hybrid().split(",\nf AS")[0] + """,
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id),
placed AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS place, id, score, e FROM f JOIN w USING (id)),
sims AS (SELECT x.place AS place, x.score AS score, list(coalesce(list_cosine_similarity(x.e, y.e), 0) ORDER BY y.place) AS near FROM placed x, placed y GROUP BY ALL),
tab AS (SELECT list(score ORDER BY place) AS rel, list(near ORDER BY place) AS near, count(*) AS total FROM sims),
greedy AS (SELECT 0 AS turn, CAST([] AS BIGINT[]) AS chosen, list_transform(rel, lambda r: CAST(0 AS DOUBLE)) AS closest FROM tab
      UNION ALL
      SELECT turn + 1, list_append(chosen, pick), list_transform(closest, lambda c, i: greatest(c, near[pick][i]))
      FROM (SELECT turn, chosen, closest, near, list_transform(rel, lambda r, i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE 0.5 * r - 0.5 * closest[i] END) AS v,
                   list_position(v, list_max(v)) AS pick FROM greedy, tab WHERE turn < least(10, total))),
picked AS (SELECT unnest(chosen) AS place, unnest(range(1, len(chosen) + 1)) AS position FROM greedy WHERE turn = (SELECT max(turn) FROM greedy))
SELECT id, round(score, 4) AS score, CAST(position AS INTEGER) AS position, document_id, ordinal, content FROM picked JOIN placed USING (place) JOIN w USING (id)"""
MMR = MMR.replace("WITH ", "WITH RECURSIVE ", 1)


@query(MMR)
def hybrid_mmr(spark, sf_dir):
    return _searched(spark, sf_dir, use_mmr=True)


@query(_hybrid().split(",\nf AS")[0] + """, u AS (SELECT id FROM a UNION ALL SELECT id FROM b)
SELECT 'vector' AS stage, CAST(count(*) AS BIGINT) AS n FROM a UNION ALL SELECT 'lexical', count(*) FROM b UNION ALL SELECT 'fuse', count(DISTINCT id) FROM u UNION ALL SELECT 'rerank', least(10, count(DISTINCT id)) FROM u""")
def hybrid_trace(spark, sf_dir):
    """How many rows each stage of a hybrid search gives."""
    trace = retrieval.Trace()
    _searched(spark, sf_dir, trace=trace)
    return spark.createDataFrame([(s["stage"], s["count"]) for s in trace.stages], "stage string, n long")


@query(f"""WITH {CHUNKS}, {VEC}, k AS (SELECT count(*) AS k FROM embeddings), w AS (SELECT chunk.*, e FROM chunk, k JOIN v ON v.vec_id = (chunk.doc_id * 31 + chunk.ordinal) % k)
SELECT id, round({L2}, 4) AS distance, document_id, CAST(ordinal AS BIGINT) AS ordinal, content FROM w, q ORDER BY round({L2}, 9), id LIMIT 7""")
def stored_search(spark, sf_dir):
    """The same search of a store twice: through its index, all cells of which are probed, then from the cache; k is capped at 7."""
    chunks = scratch.keep(corpus.embedded_chunks(spark, sf_dir), "embedded-chunks")
    store = Store(spark, scratch.new_path(spark, "store"), Limits(max_k=7))
    store.ingest(corpus.documents(spark, sf_dir).drop("text"), chunks)
    searcher = Searcher(store, index_from=0, cells=8, probes=8)
    asked = corpus.query_vector(spark, sf_dir)
    searcher.vector_search(asked, 50)
    return _rounded(searcher.vector_search(asked, 50), "distance")


# knowledge graph


def _entities(spark, sf_dir):
    return corpus.entities(spark, sf_dir)


def _relations(spark, sf_dir):
    return corpus.relations(spark, sf_dir)


@query(f"WITH {ENTITIES} SELECT entity_type, CAST(count(*) AS BIGINT) AS cnt FROM ent GROUP BY 1")
def entity_stats(spark, sf_dir):
    return graph.entity_stats(_entities(spark, sf_dir))


@query(f"WITH {RELATIONS} SELECT r AS relation_type, CAST(count(*) AS BIGINT) AS cnt FROM rel GROUP BY 1")
def relation_stats(spark, sf_dir):
    return graph.relation_stats(_relations(spark, sf_dir))


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT CAST((SELECT count(*) FROM ent) AS BIGINT) AS entity_count, CAST((SELECT count(*) FROM rel) AS BIGINT) AS relation_count")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(_entities(spark, sf_dir), _relations(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS document_count, CAST((SELECT count(*) FROM chunk) AS BIGINT) AS chunk_count")
def rag_stats(spark, sf_dir):
    a, b = corpus.documents(spark, sf_dir).agg(F.count("*").alias("document_count")), corpus.chunks(spark, sf_dir).agg(F.count("*").alias("chunk_count"))
    return a.join(F.broadcast(b))


def _degree(ends: str) -> str:
    return f"WITH {RELATIONS} SELECT name, CAST(count(*) AS BIGINT) AS degree FROM ({ends}) GROUP BY name"


@query(_degree("SELECT f AS name FROM rel"))
def degree_out(spark, sf_dir):
    return graph.degrees(_relations(spark, sf_dir), "out")


@query(_degree("SELECT t AS name FROM rel"))
def degree_in(spark, sf_dir):
    return graph.degrees(_relations(spark, sf_dir), "in")


@query(_degree("SELECT f AS name FROM rel UNION ALL SELECT t FROM rel"))
def degree_both(spark, sf_dir):
    return graph.degrees(_relations(spark, sf_dir), "both")


@query(f"WITH {RELATIONS} SELECT CAST(count(*) FILTER (WHERE f = 'nation:3') + count(*) FILTER (WHERE t = 'nation:3') AS BIGINT) AS degree FROM rel")
def entity_degree(spark, sf_dir):
    return graph.degree(_relations(spark, sf_dir), "nation:3")


def _graph(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Entities and relations as one table."""
    own, relations = found
    none = F.lit(None).cast("string")
    return own.select(F.lit("entity").alias("item"), "name", "entity_type", F.to_json("observations").alias("observations"), none.alias("from_entity"), none.alias("relation_type"), none.alias("to_entity")).union(relations.select(F.lit("relation"), none, none, none, "from_entity", "relation_type", "to_entity"))


def _graph_sql(page: str, touching: str) -> str:
    return f"""WITH {ENTITIES}, {RELATIONS}, page AS ({page}), x AS ({touching})
SELECT 'entity' AS item, name, entity_type, '["' || o || '"]' AS observations, NULL AS from_entity, NULL AS relation_type, NULL AS to_entity FROM page
UNION ALL SELECT 'relation', NULL, NULL, NULL, f, r, t FROM x"""


TOUCHING = "SELECT * FROM rel WHERE f IN (SELECT name FROM page) OR t IN (SELECT name FROM page)"


@query(_graph_sql("SELECT * FROM ent WHERE entity_type = 'nation' ORDER BY name LIMIT 5 OFFSET 3", TOUCHING))
def read_graph_page(spark, sf_dir):
    return _graph(graph.read_graph(_entities(spark, sf_dir), _relations(spark, sf_dir), "nation", 5, 3))


@query(_graph_sql("SELECT * FROM ent WHERE (name LIKE '%ier:1%' OR entity_type LIKE '%ier:1%') ORDER BY name LIMIT 10", TOUCHING))
def search_nodes(spark, sf_dir):
    return _graph(graph.search_nodes(_entities(spark, sf_dir), _relations(spark, sf_dir), "IER:1", limit=10))


NAMES = ["supplier:3", "nation:2", "missing", "order:7", "nation:2"]


@query(f"""WITH {ENTITIES}, a AS (SELECT unnest({NAMES}) AS asked, unnest(range({len(NAMES)})) AS pos)
SELECT CAST(pos AS INTEGER) AS pos, name, entity_type, o AS observation FROM a JOIN ent ON name = asked""")
def open_nodes(spark, sf_dir):
    own, _ = graph.open_nodes(_entities(spark, sf_dir), _relations(spark, sf_dir), NAMES)
    return own.select("pos", "name", "entity_type", F.get("observations", F.lit(0)).alias("observation"))


@query(f"WITH {RELATIONS} SELECT DISTINCT f AS from_entity, r AS relation_type, t AS to_entity FROM rel WHERE f IN {tuple(NAMES)} OR t IN {tuple(NAMES)}")
def open_nodes_relations(spark, sf_dir):
    return graph.open_nodes(_entities(spark, sf_dir), _relations(spark, sf_dir), NAMES)[1]


@query(f"WITH {RELATIONS} SELECT f AS from_entity, r AS relation_type, t AS to_entity FROM rel WHERE t = 'nation:4' AND r = 'in_nation'")
def search_relations(spark, sf_dir):
    return graph.search_relations(_relations(spark, sf_dir), "", "nation:4", "in_nation")


ASKED = "('customer:1', 'order:1', 'nowhere')"


def _neighbours(where: str) -> str:
    return _graph_sql("SELECT * FROM ent WHERE name IN (SELECT f FROM x UNION SELECT t FROM x)", f"SELECT DISTINCT * FROM rel WHERE {where}").replace("page AS (", "x AS (SELECT DISTINCT * FROM rel WHERE " + where + "), page AS (").replace(f"), x AS (SELECT DISTINCT * FROM rel WHERE {where})\nSELECT", ")\nSELECT")


def _around(spark, sf_dir, way: str) -> DataFrame:
    return _graph(graph.neighbors(_entities(spark, sf_dir), _relations(spark, sf_dir), ["customer:1", "order:1", "nowhere"], way))


@query(_neighbours(f"f IN {ASKED}"))
def neighbors_out(spark, sf_dir):
    return _around(spark, sf_dir, "outgoing")


@query(_neighbours(f"t IN {ASKED}"))
def neighbors_in(spark, sf_dir):
    return _around(spark, sf_dir, "IN")


@query(_neighbours(f"(f IN {ASKED} OR t IN {ASKED})"))
def neighbors_both(spark, sf_dir):
    return _around(spark, sf_dir, "both")


BFS = f"""WITH RECURSIVE {RELATIONS}, step AS (SELECT f AS a, t AS b FROM rel UNION SELECT t, f FROM rel),
walk AS (SELECT 'customer:1' AS name, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN step ON a = name WHERE depth < 3),
d AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name)"""


@query(f"{BFS} SELECT name, CAST(depth AS INTEGER) AS depth, (SELECT min(a) FROM step JOIN d p ON p.name = a WHERE b = d.name AND p.depth = d.depth - 1) AS parent FROM d")
def bfs_distance(spark, sf_dir):
    return graph.bfs(_relations(spark, sf_dir), "customer:1", 3)


BFS_PATH = BFS.replace("depth < 3", "depth < 6") + """,
y AS (SELECT d.name, d.depth, min(p.name) AS parent FROM d LEFT JOIN step ON b = d.name LEFT JOIN d p ON p.name = a AND p.depth = d.depth - 1 GROUP BY ALL),
back AS (SELECT name, depth, parent FROM y WHERE name = 'supplier:7' UNION ALL SELECT y.name, y.depth, y.parent FROM back JOIN y ON y.name = back.parent)
SELECT CAST(depth AS INTEGER) AS position, name FROM back"""


@query(BFS_PATH)
def bfs_path(spark, sf_dir):
    return graph.path_table(_relations(spark, sf_dir), "customer:1", "supplier:7", 6)


FULLTEXT = "lower(name) LIKE '%building%' OR lower(entity_type) LIKE '%building%' OR lower('[\"' || o || '\"]') LIKE '%building%'"


@query(f"WITH {ENTITIES} SELECT DISTINCT name, entity_type, '[\"' || o || '\"]' AS observations FROM ent WHERE {FULLTEXT} ORDER BY ALL LIMIT 20")
def fulltext(spark, sf_dir):
    return graph.fulltext(_entities(spark, sf_dir), corpus.observations(spark, sf_dir), "Building")


# documents as stored


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS uri, lang AS title, '{\"n_chars\":' || n_chars || '}' AS metadata FROM documents ORDER BY id LIMIT 50 OFFSET 10")
def list_documents(spark, sf_dir):
    return corpus.documents(spark, sf_dir).drop("text").orderBy("id").offset(10).limit(50)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS uri, lang AS title, text FROM documents WHERE doc_id = 42")
def get_document(spark, sf_dir):
    return corpus.documents(spark, sf_dir).filter(F.col("id") == "42").select("id", "uri", "title", "text")


@query("SELECT min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text")
def ingest_dedup(spark, sf_dir):
    """Documents with equal content, by their content hash."""
    own = corpus.table(spark, sf_dir, "documents").withColumn("h", content_hash(F.col("text")))
    return own.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).drop("h")


def _store(spark) -> Store:
    return Store(spark, scratch.new_path(spark, "store"))


def _stored(spark, sf_dir, chunked: bool = True) -> tuple[Store, DataFrame, DataFrame]:
    """A new store with all documents and their chunks, and what was sent."""
    docs = corpus.documents(spark, sf_dir).drop("text")
    chunks = corpus.chunks(spark, sf_dir).withColumn("embedding", F.array().cast("array<float>"))
    chunks = scratch.keep(chunks if chunked else chunks.limit(0), "chunks")
    store = _store(spark)
    store.ingest(docs, chunks)
    return store, docs, chunks


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 3 = 0")
def upsert_latest(spark, sf_dir):
    """Documents not divisible by 7 are stored; then every third arrives anew and replaces or joins them."""
    docs, store = corpus.documents(spark, sf_dir).drop("text"), _store(spark)
    number, none = F.col("id").cast("long"), corpus.chunks(spark, sf_dir).limit(0).withColumn("embedding", F.array().cast("array<float>"))
    store.ingest(docs.filter(number % 7 != 0), none)
    store.ingest(docs.filter(number % 3 == 0).withColumn("title", F.lit("new")), none)
    return store.read("document").select(number.alias("doc_id"), F.col("title").alias("lang"))


@query(f"WITH {CHUNKS} SELECT document_id, CAST(count(*) AS BIGINT) AS chunks FROM chunk WHERE doc_id % 5 <> 0 GROUP BY 1")
def delete_cascade(spark, sf_dir):
    """What is left of each document's chunks after every fifth document is deleted."""
    store, docs, _ = _stored(spark, sf_dir)
    store.delete_documents(docs.filter(F.col("id").cast("long") % 5 == 0).select("id"))
    return store.read("chunk").groupBy("document_id").agg(F.count("*").alias("chunks"))


@query(f"""WITH {CHUNKS}, k AS (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1), x AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT 'first' AS sent, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS skipped FROM x
UNION ALL SELECT 'again', 0, 0, count(*) FROM x
UNION ALL SELECT 'every third changed', count(*) FILTER (WHERE doc_id % 3 = 0), coalesce(sum(n) FILTER (WHERE doc_id % 3 = 0), 0), count(*) FILTER (WHERE doc_id % 3 <> 0) FROM x""")
def store_ingest(spark, sf_dir):
    """What three batches of all documents write: new ones, the same, and the same with every third title changed."""
    store, docs, chunks = _store(spark), *_sent(spark, sf_dir)
    changed = docs.withColumn("title", F.when(F.col("id").cast("long") % 3 == 0, F.lit("changed")).otherwise(F.col("title")))
    counts = [(name, *store.ingest(batch, chunks).values()) for name, batch in (("first", docs), ("again", docs), ("every third changed", changed))]
    return spark.createDataFrame(counts, "sent string, documents long, chunks long, skipped long")


def _sent(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    chunks = corpus.chunks(spark, sf_dir).withColumn("embedding", F.array().cast("array<float>"))
    return corpus.documents(spark, sf_dir).drop("text"), scratch.keep(chunks, "chunks")


@query(f"WITH {CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS id, source AS uri, lang AS title, (SELECT CAST(count(*) AS BIGINT) FROM chunk c WHERE c.doc_id = d.doc_id) AS chunk_count FROM documents d")
def store_documents(spark, sf_dir):
    """Stored documents with their counts of chunks, after all were sent twice."""
    store, docs, chunks = _stored(spark, sf_dir)
    store.ingest(docs, chunks)
    return store.read("document").select("id", "uri", "title", "chunk_count")


@query(f"WITH {CHUNKS} SELECT id, document_id, ordinal, CASE WHEN ordinal = 0 THEN 'changed' ELSE content END AS content FROM (SELECT id, document_id, CAST(ordinal AS BIGINT) AS ordinal, content FROM chunk)")
def store_upsert_chunks(spark, sf_dir):
    """Each document's first chunk is replaced."""
    store, _, chunks = _stored(spark, sf_dir)
    store.upsert_chunks(chunks.filter("ordinal = 0").withColumn("content", F.lit("changed")))
    return store.read("chunk").select("id", "document_id", "ordinal", "content")


def _graph_store(spark, sf_dir) -> Store:
    """A store of the whole graph and all vectors, after one write of each other kind."""
    store = _store(spark)
    store.create_entities(_entities(spark, sf_dir))
    store.create_relations(_relations(spark, sf_dir))
    own = _vectors(spark, sf_dir).select("id", F.concat(F.lit("label:"), "label").alias("entity_name"), F.concat(F.lit("vector "), "id").alias("text_content"), "embedding")
    store.upsert_vectors(own)
    store.upsert_vectors(own.filter("id like '%5'").withColumn("text_content", F.lit("sent again")))
    store.add_observations("region:1", ["large", "warm"])
    store.add_observations("region:9", ["of no entity"])
    store.delete_observations("region:1", ["warm", "cold"])
    store.delete_entities(["customer:1", "order:7", "nation:3"], cascade=True)
    store.delete_entities(["supplier:2"])
    store.delete_relation("nation:4", "in_region", "region:4")
    store.delete_vectors(entity_name="label:3")
    store.delete_vectors(id="7")
    return store


GONE = "('customer:1', 'order:7', 'nation:3')"


@query(f"""WITH {ENTITIES} SELECT name, entity_type, CASE WHEN name = 'region:1' THEN to_json(list_sort([o, 'large'])) ELSE to_json([o]) END AS observations
FROM ent WHERE name NOT IN {GONE} AND name <> 'supplier:2'""")
def store_entities(spark, sf_dir):
    return _graph_store(spark, sf_dir).entities().withColumn("observations", F.to_json("observations"))


@query(f"""WITH {RELATIONS} SELECT r AS relation_type, CAST(count(*) AS BIGINT) AS n, min(f) AS least, max(t) AS greatest FROM rel
WHERE f NOT IN {GONE} AND t NOT IN {GONE} AND NOT (f = 'nation:4' AND t = 'region:4') GROUP BY 1""")
def store_relations(spark, sf_dir):
    found = _graph_store(spark, sf_dir).read("relation")
    return found.groupBy("relation_type").agg(F.count("*").alias("n"), F.min("from_entity").alias("least"), F.max("to_entity").alias("greatest"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'label:' || label AS entity_name, CASE WHEN vec_id % 10 = 5 THEN 'sent again' ELSE 'vector ' || vec_id END AS text_content, CAST(len(embedding) AS INTEGER) AS size FROM embeddings WHERE label <> 3 AND vec_id <> 7")
def store_vectors(spark, sf_dir):
    return _graph_store(spark, sf_dir).read("vector").select("id", "entity_name", "text_content", F.size("embedding").alias("size"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'vector ' || vec_id AS text_content FROM embeddings WHERE label = 6 ORDER BY 1")
def vectors_by_entity(spark, sf_dir):
    own = _vectors(spark, sf_dir).select("id", F.concat(F.lit("label:"), "label").alias("entity_name"), F.concat(F.lit("vector "), "id").alias("text_content"), "embedding")
    store = _store(spark)
    store.upsert_vectors(own)
    return store.vectors_of("label:6").select("id", "text_content")


@query(f"WITH {CHUNKS} SELECT id, CAST(ordinal AS BIGINT) AS ordinal, content, CAST(token_count AS BIGINT) AS token_count FROM chunk WHERE document_id = '3' ORDER BY ordinal")
def chunks_by_document(spark, sf_dir):
    store, _, _ = _stored(spark, sf_dir)
    return store.chunks_of("3").select("id", "ordinal", "content", "token_count")


WRITES = {
    "ingest": 2, "upsert_chunks": 1, "delete_documents": 1, "create_entities": 1, "create_relations": 1, "delete_entities": 1, "delete_relation": 3, "add_observations": 2, "delete_observations": 2, "upsert_vectors": 1, "delete_vectors": 1, "commit": 0,
}


@query("SELECT unnest(" + str(list(WRITES)) + ") AS method, true AS refused, CAST(0 AS BIGINT) AS version")
def writes_refused(spark, sf_dir):
    """A restricted store refuses every write before it looks at its arguments."""
    store, out = Store(spark, scratch.new_path(spark, "store"), Limits(restricted=True)), []
    for method, n in WRITES.items():
        try:
            getattr(store, method)(*[None] * n)
            out.append((method, False, store.version))
        except PermissionError:
            out.append((method, True, store.version))
    return spark.createDataFrame(out, "method string, refused boolean, version long")


@query(f"""WITH {ENTITIES}, {RELATIONS} SELECT 'entity' AS name, CAST((SELECT count(*) FROM ent) AS BIGINT) AS n UNION ALL SELECT 'relation', (SELECT count(*) FROM rel) UNION ALL SELECT 'observation', (SELECT count(*) FROM ent)
UNION ALL SELECT 'vector', 0 UNION ALL SELECT 'document', 0 UNION ALL SELECT 'chunk', 0""")
def store_counts(spark, sf_dir):
    store = _store(spark)
    store.create_entities(_entities(spark, sf_dir))
    store.create_relations(_relations(spark, sf_dir))
    return spark.createDataFrame(list(store.counts().items()), "name string, n long")


@query(f"WITH {ENTITIES}, a AS (SELECT unnest({['region:1', 'region:9', 'part:3']}) AS name) SELECT name, EXISTS (SELECT 1 FROM ent WHERE ent.name = a.name) AS found FROM a")
def has_observations(spark, sf_dir):
    store = _store(spark)
    store.create_entities(_entities(spark, sf_dir))
    return spark.createDataFrame([(n, store.has_observations(n)) for n in ("region:1", "region:9", "part:3")], "name string, found boolean")


# extraction


@query("SELECT event_id, 'json' AS format, 'k ' || json_extract_string(props, '$.k') AS text, CAST(1 AS BIGINT) AS units FROM events")
def json_to_text(spark, sf_dir):
    got = extract.extracted(F.col("props"), fmt="json")
    return corpus.table(spark, sf_dir, "events").select("event_id", got.alias("x")).select("event_id", "x.format", "x.text", "x.units")


@query("SELECT c_custkey, 'key name segment' || chr(10) || c_custkey || ' ' || c_name || ' a \"b\", ' || c_mktsegment || chr(10) AS text, CAST(2 AS BIGINT) AS units FROM customer")
def csv_to_text(spark, sf_dir):
    content = F.concat(F.lit("key,name,segment\r\n"), F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(',"a ""b"", '), "c_mktsegment", F.lit('"\n\n'))
    got = extract.extracted(content, fmt="csv")
    return corpus.table(spark, sf_dir, "customer").select("c_custkey", got.alias("x")).select("c_custkey", "x.text", "x.units")


@query("SELECT 'html' AS format, CAST(count(*) AS BIGINT) AS n FROM pages UNION ALL SELECT 'json', count(*) FROM events UNION ALL SELECT 'csv', count(*) FROM customer")
def detect_format(spark, sf_dir):
    html = corpus.table(spark, sf_dir, "pages").select("html")
    props = corpus.table(spark, sf_dir, "events").select("props")
    lines = corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("key,name\n"), F.col("c_custkey").cast("string"), F.lit(","), "c_name"))
    found = html.union(props).union(lines).select(extract.detected(F.col("html")).alias("format"))
    return found.groupBy("format").agg(F.count("*").alias("n"))


@query()
def html_to_text(spark, sf_dir):
    got = extract.extracted(F.col("html"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", got.alias("x")).select("page_id", "x.format", "x.text", "x.units")


@query("SELECT event_id, 'json' AS format, CAST(0 AS INTEGER) AS ordinal, 'k ' || json_extract_string(props, '$.k') AS content, CAST(2 AS INTEGER) AS token_count FROM events")
def extract_and_chunk(spark, sf_dir):
    own = corpus.table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("content"))
    return chunking.extract_and_chunk(own, "event_id")


def _shown(spark, sf_dir, table: str, key: str, content, fmt: str | None = None) -> DataFrame:
    """Text of content that is put together from a table's rows; its format is detected unless given."""
    got = extract.extracted(content, fmt=fmt)
    return corpus.table(spark, sf_dir, table).select(key, got.alias("x")).select(key, "x.format", "x.text", "x.units", "x.status")


@query("SELECT event_id, 'ndjson' AS format, 'id ' || event_id || ' type ' || event_type || chr(10) || 'k ' || json_extract_string(props, '$.k') AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM events")
def ndjson_to_text(spark, sf_dir):
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('","none":""}'))
    content = F.concat(F.regexp_replace(line, ',"none":""', ""), F.lit("\n"), "props", F.lit("\n"))
    return _shown(spark, sf_dir, "events", "event_id", content)


@query("SELECT s_suppkey, 'tsv' AS format, 'name' || ' ' || 'nation' || chr(10) || s_name || ' ' || s_nationkey || chr(10) AS text, CAST(2 AS BIGINT) AS units, 'ok' AS status FROM supplier")
def tsv_to_text(spark, sf_dir):
    content = F.concat(F.lit("name\tnation\n"), "s_name", F.lit("\t"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    return _shown(spark, sf_dir, "supplier", "s_suppkey", content)


@query("SELECT p_partkey, 'xml' AS format, p_name || ' & ' || p_brand || ' <' || p_size || '>' AS text, CAST(4 AS BIGINT) AS units, 'ok' AS status FROM part")
def xml_to_text(spark, sf_dir):
    content = F.concat(F.lit("<part><name>\n "), "p_name", F.lit(" &amp; "), "p_brand", F.lit("</name><!-- no <b> text --> &lt;"), F.col("p_size").cast("string"), F.lit("&#62;</part>"))
    return _shown(spark, sf_dir, "part", "p_partkey", content)


@query("SELECT conv_id, turn, 'text' AS format, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'end' AS text FROM conversations")
def plain_to_text(spark, sf_dir):
    got = extract.extracted(F.concat(F.lit("\ufeff"), "text", F.lit("\r\nend")), fmt="text")
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", got.alias("x")).select("conv_id", "turn", "x.format", "x.text")


@query("SELECT n_nationkey || ' ' || n_name || ' ' || n_regionkey AS line FROM nation")
def parquet_to_text(spark, sf_dir):
    return extract.parquet_rows(spark, f"{sf_dir}/nation.parquet")


@query("SELECT 'c_custkey c_name c_nationkey c_acctbal c_mktsegment' AS line UNION ALL SELECT c_custkey || ' ' || c_name || ' ' || c_nationkey || ' ' || regexp_replace(CAST(c_acctbal AS DECIMAL(18, 2))::VARCHAR, '\\.?0+$', '') || ' ' || c_mktsegment FROM customer")
def parquet_with_header(spark, sf_dir):
    return extract.parquet_rows(spark, f"{sf_dir}/customer.parquet", header=True)


#: A start for each format that its bytes alone tell.
SAMPLES = {"pdf": b"%PDF-1.7 x", "legacy_doc": bytes.fromhex("d0cf11e0a1b11ae1"), "gzip": b"\x1f\x8b\x08\x00", "parquet": b"PAR1----PAR1", "arrow": b"ARROW1--ARROW1", "docx": b"PK\x03\x04", "iceberg": b'{"format-version":2,"table-uuid":"u"}', "ndjson": b'{"a":1}\n[2]\n', "json": b' {"a":1}', "html": b"<!doctype html><html>", "xml": b"<?xml?><a/>", "tsv": b"a\tb\n1\t2\n", "csv": b"a,b\n1,2\n", "text": b"some words", "unknown": b" \n"}


@query("SELECT n_nationkey, unnest(" + str(list(SAMPLES)) + ") AS format FROM nation")
def detect_all_formats(spark, sf_dir):
    rows = F.explode(F.array(*(F.lit(x) for x in SAMPLES.values()))).alias("content")
    return corpus.table(spark, sf_dir, "nation").select("n_nationkey", rows).select("n_nationkey", extract.detected(F.col("content")).alias("format"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, sf_dir):
    found = event_windows(corpus.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf_hybrid(spark, sf_dir)
