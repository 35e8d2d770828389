"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import embedding_dedup, language, mixing, near_dup, packing, quality, scratch, secrets, surrogates, url_filters, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


#: 2024-01-01 in seconds. The tables have no dates: a page's time of fetching and the list's dated entries follow from ids and hosts by rule.
EPOCH = 1_704_067_200


def _list_entries(pages: DataFrame) -> DataFrame:
    """Hosts are listed, taken off and listed again on days that their digest gives; some /en paths are listed too."""
    hosts = pages.select(url_filters.host(F.col("url")).alias("host")).filter("host is not null").distinct()
    hosts = hosts.withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("long"))
    day = lambda d: F.lit(EPOCH) + d * 86_400
    listed = hosts.filter("v % 3 = 0").select(F.concat(F.lit("domain:"), "host").alias("address"), F.lit(True).alias("listed"), day(F.col("v") % 300).alias("at"), "v")
    off = listed.filter("v % 2 = 0").select("address", F.lit(False).alias("listed"), (F.col("at") + 40 * 86_400).alias("at"))
    again = listed.filter("v % 5 = 0").select("address", "listed", (F.col("at") + 100 * 86_400).alias("at"))
    paths = hosts.filter("v % 4 = 1").select(F.concat(F.lit("prefix:"), "host", F.lit("/en")).alias("address"), F.lit(True).alias("listed"), day(F.col("v") % 200).alias("at"))
    return listed.drop("v").union(off).union(again).union(paths)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.lit(EPOCH) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))).alias("fetched_at"))
    return url_filters.evaluate(captures, _list_entries(pages))


OP1 = f"""
WITH c AS (SELECT page_id, {EPOCH} + (page_id * 7919) % 31536000 AS fetched_at, url,
             lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
             regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) AS v FROM c WHERE host <> ''),
l AS (SELECT host, v, {EPOCH} + v % 300 * 86400 AS since FROM h WHERE v % 3 = 0),
e AS (SELECT 'd' AS kind, host, true AS listed, since FROM l
      UNION ALL SELECT 'd', host, false, since + 40 * 86400 FROM l WHERE v % 2 = 0
      UNION ALL SELECT 'd', host, true, since + 100 * 86400 FROM l WHERE v % 5 = 0
      UNION ALL SELECT 'p', host, true, {EPOCH} + v % 200 * 86400 FROM h WHERE v % 4 = 1),
m AS (SELECT c.page_id, e.kind, e.host, arg_max(e.listed, e.since) AS listed FROM c JOIN e
      ON e.since <= c.fetched_at AND ((e.kind = 'd' AND (c.host = e.host OR ends_with(c.host, '.' || e.host)))
                                   OR (e.kind = 'p' AND c.host = e.host AND c.segment = 'en'))
      GROUP BY ALL),
n AS (SELECT page_id, count(*) AS n FROM m WHERE listed GROUP BY page_id)
SELECT page_id, CAST(fetched_at AS BIGINT) AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, n IS NOT NULL AS blocked
FROM c LEFT JOIN n USING (page_id)
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), mixing.Settings(entropy=0.95, most_repeats=4.0))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return scratch.settle(lambda: packing.digest(packing.pack(docs, **tokenizer_files())), "pieces", packing.BATCH_BYTES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
f AS (SELECT digest, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""


#: Common table expressions: ``joined`` (node, component) from ``link`` (x, y).
COMPONENTS = """
both_ways AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = other),
joined AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP7 = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS norm FROM e
      WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT * FROM n WHERE norm > 0),
link AS (SELECT p.vec_id AS x, q.vec_id AS y FROM u p JOIN u q ON p.vec_id < q.vec_id AND list_inner_product(p.v, q.v) / (p.norm * q.norm) >= 0.9),
{COMPONENTS.strip()},
degree AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM e LEFT JOIN joined ON joined.node = vec_id LEFT JOIN degree ON degree.node = vec_id
"""


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), near_dup.Settings(similarity_pct=85))


OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END)) AS shingles FROM w),
d AS (SELECT doc_id, len(shingles) AS n, sha256(array_to_string(shingles, ' | ')) AS name, shingles FROM s),
c AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles, name FROM d WHERE n > 0 GROUP BY name),
p AS (SELECT rep, n, unnest(shingles) AS shingle FROM c),
m AS (SELECT x.rep AS x, y.rep AS y, x.n + y.n AS total, count(*) AS shared FROM p x JOIN p y ON x.shingle = y.shingle AND x.rep < y.rep
      AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
link AS (SELECT x, y FROM m WHERE 100 * shared >= 85 * (total - shared)),
{COMPONENTS.strip()},
k AS (SELECT name, coalesce(component, rep) AS class FROM c LEFT JOIN joined ON node = rep)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(class, doc_id) AS component_id, doc_id = coalesce(class, doc_id) AS kept
FROM d LEFT JOIN k ON d.name = k.name AND n > 0
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_warc": op5_warc,
    "op6_source_mixing": op6_source_mixing,
    "op7_embedding_near_dup": op7_embedding_near_dup,
    "op8_minhash_near_dup": op8_minhash_near_dup,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
}

SQL: dict[str, str] = {"op1_url_filters": OP1, "op5_warc": OP5, "op7_embedding_near_dup": OP7, "op8_minhash_near_dup": OP8}
