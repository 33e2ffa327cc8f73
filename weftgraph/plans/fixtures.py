"""Graphs and corpora derived from the driver's tables, each as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import rank
from weftgraph.plans.staging import exists, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KINDS = (("region", "r_regionkey", "MODULE", "r_name", None), ("nation", "n_nationkey", "FILE", "n_name", None), ("customer", "c_custkey", "CLASS", "c_name", "c_mktsegment"), ("supplier", "s_suppkey", "FUNCTION", "s_name", None), ("part", "p_partkey", "CONFIG", "p_name", "p_brand"))
_OWNERS = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"))


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


_WRITTEN: dict[tuple[str, str, str], tuple[DataFrame, ...]] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, make) -> tuple[DataFrame, ...]:
    """What a store holds: written once for each application and folder, and again if it was removed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN or not all(map(exists, _WRITTEN[key])):
        _WRITTEN[key] = tuple(stage(df, name) for df in make(spark, sf_dir))
    return _WRITTEN[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes; projections of the tables, so they are read where they are needed."""
    return derive_nodes(spark, sf_dir)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a store holds them."""
    return _stored(spark, sf_dir, "edges", lambda s, d: (derive_edges(s, d),))[0]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges(spark, sf_dir)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the documents as files, as an index holds them."""
    return _stored(spark, sf_dir, "terms", lambda s, d: (rank.file_terms(files(s, d).select("id", "path", "text")),))[0]


#: Line items that a task makes different; it holds them in memory.
TASK_ROWS = 500_000


def derive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of five kinds."""
    nodes = None
    for kind, key, node_type, name, lang in _KINDS:
        meta = F.concat(F.lit('{"language":"'), F.col(lang), F.lit('"}')) if lang else F.lit(None).cast("string")
        own = table(spark, sf_dir, kind).select(_id(kind, key).alias("id"), F.lit(node_type).alias("type"), F.col(name).alias("name"), F.lit(kind).alias("source"), F.lit(1.0).alias("confidence"), meta.alias("metadata"))
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes


def derive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belonging by foreign keys, imports from line items, and a cyclic graph of nations; one edge ends at a
    node that doesn't exist. Line items are dealt into as many partitions as their number asks for, and made
    different there: pairs rarely repeat, so combining them before a shuffle would only hold them in memory."""
    pairs = [table(spark, sf_dir, a).select(_id(a, k).alias("from_node"), _id(b, f).alias("to_node"), F.lit("BELONGS_TO").alias("type"), F.lit(0.6).alias("weight")) for a, k, b, f in _OWNERS]
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = max(spark.sparkContext.defaultParallelism, items.count() // TASK_ROWS + 1)
    supply = items.select("l_partkey", "l_suppkey").repartition(n, "l_partkey", "l_suppkey").distinct().select(_id("part", "l_partkey").alias("from_node"), _id("supplier", "l_suppkey").alias("to_node"))
    bought = items.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").join(orders.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.select("o_custkey", "l_partkey").repartition(n, "o_custkey", "l_partkey").distinct()
    bought = bought.select(_id("customer", "o_custkey").alias("from_node"), _id("part", "l_partkey").alias("to_node"))
    ghost = spark.range(1).select(F.lit("nation:0").alias("from_node"), F.lit("ghost:1").alias("to_node"))
    pairs += [p.select("from_node", "to_node", F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("weight")) for p in (supply, bought, ghost)]
    n = F.col("n_nationkey")
    ring = table(spark, sf_dir, "nation").select(n.alias("f"), F.explode(F.array((n + 1) % 25, (3 * n + 2) % 25)).alias("t")).filter("f <> t").distinct()
    pairs.append(ring.select(_id("nation", "f").alias("from_node"), _id("nation", "t").alias("to_node"), F.lit("DEPENDS_ON").alias("type"), F.lit(1.0).alias("weight")))
    edges = pairs[0]
    for p in pairs[1:]:
        edges = edges.unionByName(p)
    return edges


NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{kind}:' || {key} AS id, '{t}' AS type, {name} AS name, '{kind}' AS source, 1.0::DOUBLE AS confidence, " + (f"""'{{"language":"' || {lang} || '"}}'""" if lang else "CAST(NULL AS VARCHAR)") + f" AS metadata FROM {kind}"
    for kind, key, t, name, lang in _KINDS
) + ")"
NATIONS_SQL = "SELECT DISTINCT 'nation:' || f AS from_node, 'nation:' || t AS to_node, 'DEPENDS_ON' AS type, 1.0::DOUBLE AS weight FROM (SELECT n_nationkey AS f, unnest([(n_nationkey + 1) % 25, (3 * n_nationkey + 2) % 25]) AS t FROM nation) WHERE f <> t"
EDGES_SQL = "edges AS (" + " UNION ALL ".join(
    [f"SELECT '{a}:' || {k} AS from_node, '{b}:' || {f} AS to_node, 'BELONGS_TO' AS type, 0.6::DOUBLE AS weight FROM {a}" for a, k, b, f in _OWNERS]
    + [
        "SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'IMPORTS', 1.0::DOUBLE FROM lineitem",
        "SELECT DISTINCT 'customer:' || o_custkey, 'part:' || l_partkey, 'IMPORTS', 1.0::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "SELECT 'nation:0', 'ghost:1', 'IMPORTS', 1.0::DOUBLE", NATIONS_SQL,
    ]
) + ")"
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("type = 'DEPENDS_ON'")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: id, path by source, identifier and language, text, language's ending."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "md").when(F.col("lang") == "de", "js").otherwise("txt")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select("doc_id", path.alias("path"), F.concat(F.lit("file:"), path).alias("id"), "text", F.col("doc_id").alias("ord"), "source")


FILES_SQL = """files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'js' ELSE 'txt' END AS path,
         'file:' || coalesce(source, 'none') || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'js' ELSE 'txt' END AS id,
         text, doc_id AS ord, source FROM documents
)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: paths of brand, kind and name, so that names repeat over folders."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 5 == 0, "repo_store").when(F.col("p_partkey") % 7 == 0, "eventFactory").when(F.col("p_partkey") % 11 == 0, "wrapper").otherwise("misc")
    name = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")
    return p.select(F.concat(F.col("p_brand"), F.lit("/"), kind, F.lit("/"), name, F.lit(".py")).alias("path"), F.col("p_partkey").alias("ord")).dropDuplicates(["path"])


PART_FILES_SQL = """part_files AS (
  SELECT path, min(ord) AS ord FROM (SELECT p_brand || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'repo_store' WHEN p_partkey % 7 = 0 THEN 'eventFactory' WHEN p_partkey % 11 = 0 THEN 'wrapper' ELSE 'misc' END
    || '/' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '.py' AS path, p_partkey AS ord FROM part) GROUP BY path
)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as concepts: linked to two files, one of which may not exist, and to other concepts."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.concat(F.lit("vault:"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((k % 40).cast("string"), (k * 7).cast("string"))).alias("linked_code_paths"),
        F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array((k + 1).cast("string"), k.cast("string"), (k * 1000).cast("string"))).alias("related_concepts"),
        F.lit(0.8).alias("strength"),
    )


def concept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("file:"), F.col("n_nationkey").cast("string")).alias("id"))


CONCEPTS_SQL = """concepts AS (
  SELECT 'vault:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [(c_custkey % 40)::VARCHAR, (c_custkey * 7)::VARCHAR] END AS linked,
         CASE WHEN c_custkey % 2 = 0 THEN [] ELSE [(c_custkey + 1)::VARCHAR, c_custkey::VARCHAR, (c_custkey * 1000)::VARCHAR] END AS related FROM customer
), concept_files AS (SELECT 'file:' || n_nationkey AS id FROM nation),
code_links AS (SELECT DISTINCT c.id AS from_node, 'file:' || p AS to_node FROM (SELECT id, unnest(linked) AS p FROM concepts) c JOIN concept_files f ON 'file:' || p = f.id),
concept_links AS (SELECT DISTINCT c.id AS from_node, 'vault:' || r AS to_node FROM (SELECT id, unnest(related) AS r FROM concepts) c JOIN concepts t ON 'vault:' || r = t.id WHERE c.id <> t.id)"""
