"""The registered queries of this subpackage: each derives its columns from its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import embedding_dedup, fingerprints, html_extract, langid, mixing, packing, pii, sharding, simhash_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_collisions(pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    kinds = F.transform("entities", lambda e: e["kind"])
    return found.select("row.doc_id", "text", F.size("entities").alias("n_entities"), kinds.alias("kinds"), "collisions")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.assign(docs).withColumn("law", F.lit("key"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), langid.held_out(doc_id).alias("held_out"), "lang_pred", "score")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("component_id", F.col("component_id").cast("long"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_html_extraction": op2_html_extraction,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL = {
    "op8_url_filter": r"""
WITH split_urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM split_urls
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS among
  FROM sources WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, 3 * source_size * among <= weight * rest AS stops FROM ordered
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE
    ELSE (weight * max(CASE WHEN NOT stops THEN rest END) OVER ())::DOUBLE / max(CASE WHEN NOT stops THEN among END) OVER ()::DOUBLE END AS target,
    ('0x' || substr(md5('mix-1/' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS shift FROM marked
), ranked AS (
  SELECT doc_id, size, t.source, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY t.source ORDER BY size, doc_id NULLS FIRST) - 1 AS k
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, (floor((k + 1) * each + shift) - floor(k * each + shift))::BIGINT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM mixed
""",
}
