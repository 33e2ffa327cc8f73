"""Registered queries over the derived graph: lookups, store, traversal, enrichment, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import task
from weftgraph.functions import text as T
from weftgraph.operators import enrich, lookups, rank, resolve, store, traverse
from weftgraph.plans import fixtures as X
from weftgraph.plans.registry import query

G = f"WITH {X.GRAPH_SQL} "
R = f"WITH RECURSIVE {X.GRAPH_SQL}, "


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@query("e01_find_node", f"{G} SELECT * FROM nodes WHERE id = 'part:17'")
def _(spark, d):
    return lookups.get_node(X.nodes(spark, d), "part:17")


@query("e02_find_symbol", f"{G} SELECT id, name FROM nodes WHERE contains(name, '#00') AND type = 'FUNCTION'")
def _(spark, d):
    return lookups.search_by_name(X.nodes(spark, d), "#00", "FUNCTION").select("id", "name")


@query("e03_find_by_type", f"{G} SELECT id, name FROM nodes WHERE type = 'FILE'")
def _(spark, d):
    return lookups.find_by_type(X.nodes(spark, d), "FILE").select("id", "name")


@query("e03_find_by_source", f"{G} SELECT id, name FROM nodes WHERE source = 'region'")
def _(spark, d):
    return lookups.find_by_source(X.nodes(spark, d), "region").select("id", "name")


@query("e04_find_dependents", f"{G}, own AS (SELECT * FROM edges WHERE to_node = 'part:17' AND type = 'IMPORTS') SELECT id, name, (SELECT count(*) FROM own) AS n_edges FROM nodes WHERE id IN (SELECT from_node FROM own)".replace(") , own", "), own"))
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    found, own = lookups.dependents(nodes, edges, "part:17")
    return found.select("id", "name").crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("n_edges"))))


@query("e05_find_imports", f"{G}, own AS (SELECT * FROM edges WHERE from_node = 'customer:1' AND type = 'IMPORTS') SELECT id, name, (SELECT count(*) FROM own) AS n_edges FROM nodes WHERE id IN (SELECT to_node FROM own)")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    found, own = lookups.imports(nodes, edges, "customer:1")
    return found.select("id", "name").crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("n_edges"))))


@query("e06_all_edges_for", f"{G} SELECT * FROM edges WHERE to_node = 'nation:0' UNION ALL SELECT * FROM edges WHERE from_node = 'nation:0'")
def _(spark, d):
    return lookups.all_edges_for(X.edges(spark, d), "nation:0")


_REACH = "walk AS (SELECT '{seed}' AS id, 0 AS depth UNION SELECT e.{b}, depth + 1 FROM walk JOIN edges e ON e.{a} = walk.id WHERE depth < {n}), found AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"


@query("e07_bfs_depth2", R + _REACH.format(seed="customer:1", a="from_node", b="to_node", n=2) + " SELECT nodes.id, name, depth::INTEGER AS depth FROM found JOIN nodes USING (id)")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return traverse.bfs(nodes, edges, ids(spark, "customer:1"), 2)[0].select("id", "name", "depth")


@query("e07_bfs_edges", R + _REACH.format(seed="customer:1", a="from_node", b="to_node", n=2) + " SELECT from_node, to_node, type FROM edges WHERE from_node IN (SELECT id FROM found WHERE depth < 2)")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return traverse.bfs(nodes, edges, ids(spark, "customer:1"), 2)[1].select("from_node", "to_node", "type")


@query("e08_shortest_path", f"{G.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS MATERIALIZED (SELECT DISTINCT from_node, to_node FROM edges), p AS (SELECT ['customer:1'] AS path, 'customer:1' AS here, 0 AS n UNION ALL SELECT list_append(path, to_node), to_node, n + 1 FROM p JOIN e ON from_node = here WHERE n < 5 AND here <> 'nation:17') SELECT array_to_string(path, '>') AS path FROM p WHERE here = 'nation:17' ORDER BY n, p.path LIMIT 1")
def _(spark, d):
    return traverse.shortest_path(X.edges(spark, d), "customer:1", "nation:17").select(F.array_join("path", ">").alias("path"))


@query("e09_subgraph", f"{G} SELECT from_node, to_node, type FROM edges WHERE from_node IN (SELECT id FROM nodes WHERE source IN ('nation', 'region')) AND to_node IN (SELECT id FROM nodes WHERE source IN ('nation', 'region'))")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return lookups.subgraph(nodes, edges, nodes.filter(F.col("source").isin("nation", "region")).select("id"))[1].select("from_node", "to_node", "type")


@query("e10_impact_depth3", R + _REACH.format(seed="nation:0", a="to_node", b="from_node", n=3) + ", via AS (SELECT e.from_node AS id, min(struct_pack(via := e.to_node, edge_type := e.type)) AS v FROM edges e JOIN found f ON f.id = e.to_node JOIN found g ON g.id = e.from_node WHERE g.depth = f.depth + 1 GROUP BY e.from_node) SELECT nodes.id, name, depth::INTEGER AS depth, v.via AS via, v.edge_type AS edge_type FROM found JOIN nodes USING (id) JOIN via USING (id) WHERE depth > 0")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return traverse.impact(nodes, edges, ids(spark, "nation:0"), 3)


@query("e11_counts", f"{G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


@query("e12_edge_type_summary", f"{G} SELECT type, count(*) AS n FROM edges GROUP BY type")
def _(spark, d):
    return lookups.edge_type_summary(X.edges(spark, d))


@query("e13_language_summary", f"{G} SELECT coalesce(json_extract_string(metadata, '$.language'), 'unknown') AS language, count(*) AS n FROM nodes GROUP BY 1")
def _(spark, d):
    return lookups.language_summary(X.nodes(spark, d))


_TOKENS = "tokens AS (SELECT DISTINCT token, id FROM (SELECT unnest(list_concat([lower(name), regexp_replace(list_last(string_split(lower(name), '/')), '\\.(py|js|ts)$', '')], string_split(lower(name), '/'))) AS token, id FROM nodes) WHERE token <> '')"


@query("e14_name_index", f"{G}, {_TOKENS} SELECT token, id FROM tokens")
def _(spark, d):
    return lookups.name_tokens(X.nodes(spark, d))


@query("e15_keyword_search", f"{G}, {_TOKENS} SELECT DISTINCT id FROM tokens WHERE contains(token, 'suppliers') OR contains(token, 'supplier') OR contains('supplier', token)")
def _(spark, d):
    return lookups.find_by_keyword(lookups.name_tokens(X.nodes(spark, d)), "suppliers", "supplier")


@query("e16_find_by_path", f"{G} SELECT id, name FROM nodes WHERE type = 'FILE' AND (name = 'src/NATION_7' OR ends_with(name, '/src/NATION_7') OR ends_with('src/NATION_7', name)) ORDER BY id LIMIT 1")
def _(spark, d):
    return lookups.find_by_path(X.nodes(spark, d), "src/NATION_7").select("id", "name")


@query("e17_neighbors", R + _REACH.format(seed="nation:3", a="from_node", b="to_node", n=2) + " SELECT id, depth::INTEGER AS depth FROM found WHERE depth > 0")
def _(spark, d):
    return traverse.neighbours(X.edges(spark, d), ids(spark, "nation:3"), 2).select("id", "depth")


_VIA = ", via AS (SELECT e.{b} AS id, min(struct_pack(a := e.{a}, t := e.type)) AS v FROM edges e JOIN found f ON f.id = e.{a} JOIN found g ON g.id = e.{b} WHERE g.depth = f.depth + 1 GROUP BY e.{b}) SELECT id, v.t AS edge_type, depth::INTEGER AS depth FROM found JOIN via USING (id) WHERE depth > 0"


@query("e18_upstream", R + _REACH.format(seed="supplier:3", a="to_node", b="from_node", n=2) + _VIA.format(a="to_node", b="from_node"))
def _(spark, d):
    return traverse.neighbours(X.edges(spark, d), ids(spark, "supplier:3"), 2, reverse=True)


@query("e18_downstream", R + _REACH.format(seed="customer:7", a="from_node", b="to_node", n=3) + _VIA.format(a="from_node", b="to_node"))
def _(spark, d):
    return traverse.neighbours(X.edges(spark, d), ids(spark, "customer:7"), 3)


@query("e19_related_concepts", R + _REACH.format(seed="customer:5", a="from_node", b="to_node", n=2) + " SELECT id, depth::INTEGER AS depth FROM found WHERE starts_with(id, 'supplier:')")
def _(spark, d):
    return traverse.related_concepts(X.edges(spark, d), ids(spark, "customer:5"), 2, "supplier:")


@query("e20_conflicts_for", f"WITH {X.PART_FILES_SQL}, own AS (SELECT path, lower(split_part(list_last(string_split(path, '/')), '.', 1)) AS base, regexp_replace(path, '/?[^/]*$', '') AS dir FROM part_files), pairs AS (SELECT a.path AS source_a, b.path AS source_b, a.base FROM own a JOIN own b ON a.base = b.base AND a.path < b.path AND a.dir <> b.dir WHERE a.base NOT IN ('__init__', 'setup', 'conftest', 'index')) SELECT * FROM pairs WHERE starts_with(source_a, 'Brand#11/') OR starts_with(source_b, 'Brand#11/')")
def _(spark, d):
    files = X.part_files(spark, d)
    asked = files.filter(F.col("path").startswith("Brand#11/")).select(schema.file_id(F.col("path")).alias("id"))
    return lookups.conflicts_for(enrich.naming_conflicts(files), asked)


@query("e20_patterns_for", "SELECT 'pattern:' || p_partkey AS id FROM part WHERE list_has_any(['supplier:' || (p_partkey % 40), 'supplier:' || (p_partkey * 7 % 100)], ['supplier:3', 'supplier:50'])")
def _(spark, d):
    k = F.col("p_partkey")
    supplier = lambda n: F.concat(F.lit("supplier:"), n.cast("string"))
    patterns = X.table(spark, d, "part").select(F.concat(F.lit("pattern:"), k.cast("string")).alias("id"), F.array(supplier(k % 40), supplier(k * 7 % 100)).alias("affects"))
    return lookups.patterns_for(patterns, ids(spark, "supplier:3", "supplier:50")).select("id")


_CYCLES = f"WITH RECURSIVE edges AS ({X.NATIONS_SQL}), p AS (SELECT from_node AS first, to_node AS last, [from_node, to_node] AS path FROM edges WHERE to_node > from_node UNION ALL SELECT first, to_node, list_append(path, to_node) FROM p JOIN edges ON from_node = last WHERE to_node > first AND NOT list_contains(path, to_node) AND len(path) < 4), c AS (SELECT DISTINCT list_sort(path) AS nodes FROM p WHERE EXISTS (SELECT 1 FROM edges WHERE from_node = last AND to_node = first)) "


@query("e21_cycles", _CYCLES + "SELECT array_to_string(nodes, ',') AS nodes FROM c")
def _(spark, d):
    return traverse.cycles(X.nation_edges(spark, d), 4).select(F.array_join("nodes", ",").alias("nodes"))


@query("e21_circular_dependencies", _CYCLES + "SELECT nodes[1] AS source_a, list_last(nodes) AS source_b, 'circular_dependency' AS category, 'high' AS severity, 0.9::DOUBLE AS confidence, array_to_string(nodes[1:5], ' -> ') AS description FROM c")
def _(spark, d):
    deps = X.nation_edges(spark, d).select(F.col("from_node").alias("source_file"), F.col("to_node").alias("target"))
    return traverse.circular_dependencies(deps, 4)


_SEL = "sel AS (SELECT id FROM nodes WHERE source = 'nation')"


@query("e22_dependency_snapshot", f"{G}, {_SEL}, o AS (SELECT * FROM edges WHERE from_node IN (SELECT id FROM sel)), i AS (SELECT DISTINCT from_node AS other FROM edges WHERE to_node IN (SELECT id FROM sel)), t AS (SELECT DISTINCT to_node AS other FROM o), a AS (SELECT 'direct' AS kind, row_number() OVER (ORDER BY other) AS rank, other, 50 AS n FROM (SELECT from_node || '>' || to_node || '>' || type AS other FROM o) UNION ALL SELECT 'upstream', row_number() OVER (ORDER BY other), other, 20 FROM i UNION ALL SELECT 'downstream', row_number() OVER (ORDER BY other), other, 20 FROM t) SELECT kind, rank::INTEGER AS rank, other FROM a WHERE rank <= n")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return lookups.dependency_snapshot(edges, nodes.filter("source = 'nation'").select("id"))


@query("e23_critical_edges", f"{G}, {_SEL} SELECT from_node, to_node, type FROM edges WHERE from_node IN (SELECT id FROM sel) AND to_node IN (SELECT id FROM sel) ORDER BY from_node, to_node, type LIMIT 50")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return lookups.critical_edges(edges, nodes.filter("source = 'nation'").select("id")).select("from_node", "to_node", "type")


@query("e24_node_detail", f"{G}, o AS (SELECT 'dependency' AS side, to_node AS other, type, row_number() OVER (ORDER BY to_node, type) AS k, count(*) OVER () AS total FROM edges WHERE from_node = 'nation:0' UNION ALL SELECT 'dependent', from_node, type, row_number() OVER (ORDER BY from_node, type), count(*) OVER () FROM edges WHERE to_node = 'nation:0') SELECT side, other, coalesce(name, list_last(string_split(other, '/'))) AS name, o.type, total FROM o LEFT JOIN nodes ON nodes.id = other WHERE k <= 15")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return lookups.node_detail(nodes, edges, "nation:0")


@query("e25_graph_sample", f"{G}, s AS (SELECT id FROM nodes ORDER BY id LIMIT 3000) SELECT from_node, to_node, type FROM edges WHERE from_node IN (SELECT id FROM s) AND to_node IN (SELECT id FROM s) ORDER BY from_node, to_node, type LIMIT 150")
def _(spark, d):
    return lookups.graph_sample(*X.graph(spark, d), 3000)[1].select("from_node", "to_node", "type")


@query("e26_degree", f"{G} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT from_node AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_node, 0, 1 FROM edges) GROUP BY id")
def _(spark, d):
    return lookups.degrees(X.edges(spark, d))


@query("e27_file_impact", f"{G}, own AS (SELECT id FROM nodes WHERE source = 'nation' AND name = 'NATION_3') SELECT (SELECT count(*) FROM own) AS nodes, (SELECT count(*) FROM edges WHERE to_node IN (SELECT id FROM own)) AS upstream, (SELECT count(*) FROM edges WHERE from_node IN (SELECT id FROM own)) AS downstream")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    named = nodes.filter("source = 'nation'").withColumn("metadata", F.to_json(F.struct(F.col("name").alias("file_path"))))
    return lookups.file_impact(named, edges, "NATION_3")


@query("e28_edit_downstream", R + _REACH.format(seed="nation:4", a="to_node", b="from_node", n=2) + " SELECT greatest(count(*) - 1, 0) AS downstream FROM found JOIN nodes USING (id) WHERE depth > 0")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return traverse.impact(nodes, edges, ids(spark, "nation:4"), 2).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("downstream"))


# store ----------------------------------------------------------------------------------------------


@query("d02_get_edges", f"{G} SELECT from_node, to_node, type FROM edges WHERE to_node = 'nation:5' AND type = 'BELONGS_TO'")
def _(spark, d):
    return lookups.get_edges(X.edges(spark, d), to_node="nation:5", type="BELONGS_TO").select("from_node", "to_node", "type")


@query("d09_name_search", f"{G} SELECT id, name FROM nodes WHERE contains(name, '_1')")
def _(spark, d):
    return lookups.search_by_name(X.nodes(spark, d), "_1").select("id", "name")


def batch(spark, d):
    """A batch over customers: each seventh renamed, twice, and new ones."""
    c, k = X.table(spark, d, "customer"), F.col("c_custkey")
    first = c.filter(k % 7 == 0).select(F.concat(F.lit("customer:"), k.cast("string")).alias("id"), F.lit("first").alias("name"), F.lit(1).alias("ord"))
    second = c.filter(k % 7 == 0).select(F.concat(F.lit("customer:"), k.cast("string")).alias("id"), F.concat(F.lit("second "), "c_name").alias("name"), F.lit(2).alias("ord"))
    new = c.filter(k % 11 == 0).select(F.concat(F.lit("new:"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("ord"))
    return first.union(second).union(new)


_BATCH = "batch AS (SELECT 'customer:' || c_custkey AS id, 'first' AS name, 1 AS ord FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'customer:' || c_custkey, 'second ' || c_name, 2 FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'new:' || c_custkey, c_name, 1 FROM customer WHERE c_custkey % 11 = 0), last AS (SELECT id, arg_max(name, ord) AS name FROM batch GROUP BY id)"
_UPSERTED = "SELECT id, name FROM nodes WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, name FROM last"


@query("d03_upsert", f"{G}, {_BATCH} {_UPSERTED}")
def _(spark, d):
    return store.upsert(X.nodes(spark, d).select("id", "name"), batch(spark, d), ["id"])


@query("d04_edge_upsert", f"{G}, b AS (SELECT from_node, to_node, type, 0.25::DOUBLE AS weight FROM edges WHERE type = 'BELONGS_TO' UNION ALL SELECT 'new:' || r_regionkey, 'region:0', 'CALLS', 1.0::DOUBLE FROM region) SELECT from_node, to_node, type, weight FROM edges WHERE type <> 'BELONGS_TO' UNION ALL SELECT * FROM b")
def _(spark, d):
    edges = X.edges(spark, d)
    own = edges.filter("type = 'BELONGS_TO'").withColumn("weight", F.lit(0.25))
    new = X.table(spark, d, "region").select(F.concat(F.lit("new:"), F.col("r_regionkey").cast("string")).alias("from_node"), F.lit("region:0").alias("to_node"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("weight"))
    return store.upsert(edges, own.union(new).withColumn("ord", F.lit(1)), schema.EDGE_KEY)


@query("d06_delete_cascade", f"{G}, gone AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0) SELECT from_node, to_node, type FROM edges WHERE from_node NOT IN (SELECT id FROM gone) AND to_node NOT IN (SELECT id FROM gone)")
def _(spark, d):
    gone = X.table(spark, d, "nation").filter("n_nationkey % 5 = 0").select(X._id("nation", "n_nationkey").alias("id"))
    return store.delete_nodes(*X.graph(spark, d), gone)[1].select("from_node", "to_node", "type")


@query("d07_delete_edges", f"{G} SELECT from_node, to_node, type FROM edges WHERE NOT (type = 'DEPENDS_ON' OR to_node = 'ghost:1')")
def _(spark, d):
    edges = X.edges(spark, d)
    return store.delete_edges(edges, edges.filter("type = 'DEPENDS_ON' OR to_node = 'ghost:1'")).select("from_node", "to_node", "type")


@query("d08_keys", f"{G} SELECT id AS key FROM nodes UNION ALL SELECT from_node || '|' || to_node || '|' || type FROM edges")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    return nodes.select(F.col("id").alias("key")).union(edges.select(F.concat_ws("|", *schema.EDGE_KEY)))


@query("d10_node_diff", f"{G}, {_BATCH}, new AS ({_UPSERTED}), cut AS (SELECT * FROM new WHERE NOT starts_with(id, 'region:')) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM nodes o FULL JOIN cut n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.name IS DISTINCT FROM n.name")
def _(spark, d):
    old = X.nodes(spark, d).select("id", "name")
    new = store.upsert(old, batch(spark, d), ["id"]).filter("NOT startswith(id, 'region:')")
    return store.diff(old, new, ["id"])


_EDGE_KEY = "from_node || '|' || to_node || '|' || type"


@query("d11_edge_diff", f"{G}, o AS MATERIALIZED (SELECT *, {_EDGE_KEY} AS k FROM edges), m AS (SELECT from_node, to_node, CASE WHEN type = 'DEPENDS_ON' THEN 'CALLS' ELSE type END AS type, CASE WHEN type = 'BELONGS_TO' THEN 0.5 ELSE weight END AS weight FROM edges), n AS MATERIALIZED (SELECT *, {_EDGE_KEY} AS k FROM m) SELECT from_node, to_node, type, 'added' AS change FROM n ANTI JOIN o USING (k) UNION ALL SELECT from_node, to_node, type, 'deleted' FROM o ANTI JOIN n USING (k) UNION ALL SELECT o.from_node, o.to_node, o.type, 'updated' FROM o JOIN n USING (k) WHERE o.weight <> n.weight")
def _(spark, d):
    old = X.edges(spark, d)
    new = old.withColumns({"weight": F.when(F.col("type") == "BELONGS_TO", 0.5).otherwise(F.col("weight")), "type": F.when(F.col("type") == "DEPENDS_ON", "CALLS").otherwise(F.col("type"))})
    return store.diff(old, new, schema.EDGE_KEY)


@query("d13_batch_counts", f"{G}, {_BATCH}, gone AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0), l AS (SELECT * FROM edges WHERE from_node NOT IN (SELECT id FROM gone) AND to_node NOT IN (SELECT id FROM gone)), up AS (SELECT from_node, to_node, 'CALLS' AS type FROM edges WHERE type = 'DEPENDS_ON' UNION ALL SELECT from_node, to_node, type FROM edges WHERE type = 'BELONGS_TO'), n AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)) SELECT (SELECT count(*) FROM nodes WHERE id IN (SELECT id FROM gone)) AS nodes_removed, (SELECT count(*) FROM batch WHERE id IN (SELECT id FROM n)) AS nodes_updated, (SELECT count(*) FROM batch WHERE id NOT IN (SELECT id FROM n)) AS nodes_added, (SELECT count(*) FROM up WHERE (from_node, to_node, type) IN (SELECT (from_node, to_node, type) FROM l)) AS edges_updated, (SELECT count(*) FROM up WHERE (from_node, to_node, type) NOT IN (SELECT (from_node, to_node, type) FROM l)) AS edges_added, (SELECT count(*) FROM edges) - (SELECT count(*) FROM l) + (SELECT count(*) FROM l WHERE type = 'DEPENDS_ON') AS edges_removed")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    gone = X.table(spark, d, "nation").filter("n_nationkey % 5 = 0").select(X._id("nation", "n_nationkey").alias("id"))
    depends, belongs = edges.filter("type = 'DEPENDS_ON'"), edges.filter("type = 'BELONGS_TO'")
    up = depends.withColumn("type", F.lit("CALLS")).union(belongs)
    return store.batch_counts(nodes, edges, batch(spark, d).select("id"), gone, up.select(*schema.EDGE_KEY), depends)


@query("d14_stale_nodes", f"{G} SELECT id FROM nodes WHERE NOT (source = 'part' OR source = 'customer') AND split_part(id, '::', 1) NOT IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey < 10)")
def _(spark, d):
    nodes = X.nodes(spark, d)
    kept = X.table(spark, d, "nation").filter("n_nationkey < 10").select(X._id("nation", "n_nationkey").alias("id"))
    return store.stale_nodes(nodes, nodes.filter("source IN ('part', 'customer')"), kept).select("id")


@query("d15_stale_edges", f"{G}, skip AS (SELECT id FROM nodes WHERE source = 'nation' OR source = 'region') SELECT from_node, to_node, type FROM edges WHERE type <> 'IMPORTS' AND to_node IN (SELECT id FROM nodes) AND from_node <> 'nation:7' AND to_node <> 'nation:7' AND NOT (from_node IN (SELECT id FROM skip) AND to_node IN (SELECT id FROM skip))")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    skipped = nodes.filter("source IN ('nation', 'region')").select("id")
    return store.stale_edges(edges, edges.filter("type = 'IMPORTS'"), nodes, ids(spark, "nation:7"), skipped).select(*schema.EDGE_KEY)


@query("d18_dedupe_first", "SELECT l_partkey, l_suppkey, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS l_quantity FROM lineitem GROUP BY l_partkey, l_suppkey")
def _(spark, d):
    items = X.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return store.first_per_key(items, ["l_partkey", "l_suppkey"]).drop("ord")


# enrichment -----------------------------------------------------------------------------------------

_SIGNALS = "sig(pattern, s) AS (VALUES ('repository', 'repository'), ('repository', 'repo'), ('factory', 'factory'), ('factory', 'create_'), ('factory', 'build_'), ('observer', 'observer'), ('observer', 'subscribe'), ('observer', 'event'), ('adapter', 'adapter'), ('adapter', 'wrapper'))"
_PATTERNS = f"{X.PART_FILES_SQL}, {_SIGNALS}, parts AS (SELECT path, k, part FROM (SELECT path, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS k FROM part_files)), hits AS (SELECT DISTINCT path, k, part, pattern FROM parts JOIN sig ON contains(lower(part), s)), pats AS (SELECT pattern, part, count(*) AS n, round(least(count(*) * 0.15::DOUBLE, 0.9::DOUBLE), 6) AS confidence FROM hits GROUP BY 1, 2 HAVING count(*) >= 2)"


@query("f01_design_patterns", f"WITH {_PATTERNS} SELECT * FROM pats")
def _(spark, d):
    return enrich.design_patterns(X.part_files(spark, d))


@query("f01_pattern_locations", f"WITH {_PATTERNS} SELECT pattern, part, path FROM pats JOIN part_files ON contains(lower(path), lower(part))")
def _(spark, d):
    files = X.part_files(spark, d)
    return enrich.pattern_locations(files, enrich.design_patterns(files)).select("pattern", "part", "path")


@query("f02_naming_conventions", f"WITH {X.PART_FILES_SQL}, s AS (SELECT split_part(list_last(string_split(path, '/')), '.', 1) AS stem FROM part_files), c AS (SELECT 'snake_case' AS convention, count(*) FILTER (regexp_matches(stem, '^[a-z][a-z0-9_]*$')) AS n, count(*) AS total FROM s UNION ALL SELECT 'PascalCase', count(*) FILTER (regexp_matches(stem, '^[A-Z][a-zA-Z0-9]*$')), count(*) FROM s) SELECT convention, n, round(n / total, 2) AS confidence FROM c WHERE n / total > 0.5")
def _(spark, d):
    return enrich.naming_conventions(X.part_files(spark, d))


_CONFLICTS = f"{X.PART_FILES_SQL}, own AS (SELECT path, lower(split_part(list_last(string_split(path, '/')), '.', 1)) AS base, regexp_replace(path, '/?[^/]*$', '') AS dir FROM part_files), conflicts AS (SELECT a.path AS source_a, b.path AS source_b, a.base FROM own a JOIN own b ON a.base = b.base AND a.path < b.path AND a.dir <> b.dir WHERE a.base NOT IN ('__init__', 'setup', 'conftest', 'index'))"


@query("f03_naming_conflicts", f"WITH {_CONFLICTS} SELECT * FROM conflicts")
def _(spark, d):
    return enrich.naming_conflicts(X.part_files(spark, d))


@query("f05_conflict_nodes", f"WITH {_CONFLICTS} SELECT 'conflict:naming:' || substr(sha256(source_a || '|' || source_b), 1, 12) AS id, 'CONFLICT' AS type, source_a AS source FROM conflicts")
def _(spark, d):
    return enrich.conflict_nodes(enrich.naming_conflicts(X.part_files(spark, d))).select("id", "type", "source")


@query("f05_pattern_nodes", f"WITH {_PATTERNS} SELECT 'pattern:' || pattern AS id, max(confidence) AS confidence FROM pats GROUP BY pattern")
def _(spark, d):
    return enrich.pattern_nodes(enrich.design_patterns(X.part_files(spark, d))).select("id", "confidence")


@query("f06_enrichment_edges", f"WITH {_PATTERNS}, own AS (SELECT path, lower(split_part(list_last(string_split(path, '/')), '.', 1)) AS base, regexp_replace(path, '/?[^/]*$', '') AS dir FROM part_files), conflicts AS (SELECT a.path AS source_a, b.path AS source_b FROM own a JOIN own b ON a.base = b.base AND a.path < b.path AND a.dir <> b.dir WHERE a.base NOT IN ('__init__', 'setup', 'conftest', 'index')) SELECT DISTINCT 'pattern:' || pattern AS from_node, 'file:' || path AS to_node, 'IMPLEMENTS' AS type FROM pats JOIN part_files ON contains(lower(path), lower(part)) UNION SELECT 'conflict:naming:' || substr(sha256(source_a || '|' || source_b), 1, 12), 'file:' || unnest([source_a, source_b]), 'DEPENDS_ON' FROM conflicts")
def _(spark, d):
    files = X.part_files(spark, d)
    nodes = files.select(schema.file_id(F.col("path")).alias("id"))
    return enrich.enrichment_edges(nodes, enrich.pattern_locations(files, enrich.design_patterns(files)), enrich.naming_conflicts(files))


@query("f08_concept_code_edges", f"WITH {X.CONCEPTS_SQL} SELECT from_node, to_node, 'REFERENCES' AS type, 0.8::DOUBLE AS weight FROM code_links")
def _(spark, d):
    return enrich.concept_code_edges(X.concepts(spark, d), X.concept_files(spark, d))


@query("f09_concept_links", f"WITH {X.CONCEPTS_SQL} SELECT from_node, to_node, 'LINKS_TO' AS type FROM concept_links")
def _(spark, d):
    return enrich.concept_links(X.concepts(spark, d))


@query("f10_orphan_concepts", f"WITH {X.CONCEPTS_SQL} SELECT id FROM concepts WHERE id NOT IN (SELECT from_node FROM code_links) AND id NOT IN (SELECT from_node FROM concept_links)")
def _(spark, d):
    return enrich.orphan_concepts(X.concepts(spark, d), X.concept_files(spark, d)).select("id")


# resolution -----------------------------------------------------------------------------------------

_INDEX = f"{X.PART_FILES_SQL}, m AS (SELECT path, ord, string_split(replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), '.') AS p FROM part_files), keys AS (SELECT path, ord, unnest(list_distinct(list_append(list_transform(range(1, len(p) + 1), lambda n: array_to_string(p[1:n], '.')), list_last(p)))) AS key FROM m), idx AS (SELECT key, arg_max(path, (ord, path)) AS path FROM keys GROUP BY key)"


def part_files_ordered(spark, d):
    """part_files with the least number of each path, as its SQL has it."""
    return X.part_files(spark, d).select("path", F.lit(0).alias("ord"))


@query("c01_module_index", f"WITH {_INDEX.replace('min(ord) AS ord', '0 AS ord')} SELECT key, path FROM idx")
def _(spark, d):
    return resolve.module_index(part_files_ordered(spark, d))


def part_imports(spark, d):
    """Each part file imports the next part's module by key, by relative path and by a sibling's name."""
    p = part_files_ordered(spark, d)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "")
    folder = F.split_part("path", F.lit("/"), F.lit(2))
    targets = F.array(F.struct(name.alias("t"), F.lit(0).alias("l")), F.struct(F.concat(F.lit("."), name).alias("t"), F.lit(1).alias("l")), F.struct(F.concat(F.lit(".."), folder, F.lit("."), name).alias("t"), F.lit(2).alias("l")), F.struct(F.concat(F.lit("./"), name, F.lit(".py")).alias("t"), F.lit(0).alias("l")), F.struct(F.lit("missing.module").alias("t"), F.lit(0).alias("l")))
    return p.select(F.col("path").alias("source_file"), F.posexplode(targets).alias("line", "x")).select("source_file", F.col("x.t").alias("target_module"), F.col("x.l").alias("level"), "line")


@query("c05_resolve_imports", f"""WITH {_INDEX.replace('min(ord) AS ord', '0 AS ord')}, base AS (SELECT path, regexp_replace(list_last(string_split(path, '/')), '\\.py$', '') AS name FROM part_files)
SELECT 'file:' || b.path AS from_node, 'file:' || idx.path AS to_node, 'IMPORTS' AS type, 0 AS line, name AS import_str FROM base b JOIN idx ON idx.key = name
UNION ALL SELECT 'file:' || path, 'file:' || path, 'IMPORTS', 1, '.' || name FROM base
UNION ALL SELECT 'file:' || path, 'file:' || path, 'IMPORTS', 2, '..' || split_part(path, '/', 2) || '.' || name FROM base
UNION ALL SELECT 'file:' || path, 'file:' || path, 'IMPORTS', 3, './' || name || '.py' FROM base""")
def _(spark, d):
    return resolve.resolve(part_imports(spark, d), part_files_ordered(spark, d))


@query("c03_common_root", f"WITH {X.PART_FILES_SQL}, b AS (SELECT string_split(min('src/lib/' || path), '/') AS a, string_split(max('src/lib/' || path), '/') AS z FROM part_files), i AS (SELECT a, z, unnest(range(1, least(len(a), len(z)))) AS i FROM b) SELECT string_agg(a[i], '/' ORDER BY i) AS root FROM i WHERE a[1:i] = z[1:i]")
def _(spark, d):
    return resolve.common_root(X.part_files(spark, d).select(F.concat(F.lit("src/lib/"), "path").alias("path")))


@query("c07_script_candidates", """WITH s AS (SELECT p_partkey AS k FROM part) SELECT 'file:web/' || k || '.js' AS from_node, CASE k % 3 WHEN 0 THEN 'file:lib/' || k || '.ts' WHEN 1 THEN 'file:lib/' || k || '/index.tsx' END AS to_node, 'IMPORTS' AS type, 1 AS line, '../lib/' || k AS import_str FROM s WHERE k % 3 < 2""")
def _(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 3).alias("m"))
    script = F.concat(F.lit("web/"), "k", F.lit(".js"))
    lib = F.concat(F.lit("lib/"), "k", F.when(F.col("m") == 0, ".ts").when(F.col("m") == 1, "/index.tsx").otherwise(".css"))
    files = p.select(F.explode(F.array(script, lib)).alias("path")).withColumn("ord", F.col("path"))
    deps = p.select(script.alias("source_file"), F.concat(F.lit("../lib/"), "k").alias("target_module"), F.lit(0).alias("level"), F.lit(1).alias("line"))
    return resolve.resolve(deps, files)


@query("g09_seed_expansion", R + "up AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT e.from_node, depth + 1 FROM up JOIN edges e ON e.to_node = up.id WHERE depth < 2), down AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT e.to_node, depth + 1 FROM down JOIN edges e ON e.from_node = down.id WHERE depth < 2), found AS (SELECT id, min(depth) AS depth FROM (SELECT * FROM up UNION ALL SELECT * FROM down) GROUP BY id) SELECT id, depth::INTEGER AS depth FROM found ORDER BY depth, id LIMIT 100")
def _(spark, d):
    return traverse.expand(X.edges(spark, d), ids(spark, "nation:3"), 2, 2, 100)


@query("g24_hidden_risks", f"{G} SELECT id, CASE source WHEN 'region' THEN 'high' ELSE 'medium' END || ' risk: ' || name AS message FROM nodes WHERE source IN ('region', 'nation')")
def _(spark, d):
    risk = F.when(F.col("source") == "region", "high").when(F.col("source") == "nation", "medium").otherwise("low")
    return rank.hidden_risks(X.nodes(spark, d), risk)


@query("g31_pack_edges", f"{G}, {_SEL} SELECT from_node, to_node, 'DEPENDS_ON' AS type, type AS true_type FROM edges WHERE from_node IN (SELECT id FROM sel) AND to_node IN (SELECT id FROM sel) ORDER BY from_node, to_node, edges.type LIMIT 50")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    critical = lookups.critical_edges(edges, nodes.filter("source = 'nation'").select("id"))
    return rank.pack_edges(critical).select("from_node", "to_node", "type", "true_type")


# selection ------------------------------------------------------------------------------------------

#: Questions asked of the graph: id, kind, words, their light stems, paths.
GRAPH_ASKED = (
    (1, "BUG_FIX", ("suppliers", "000000017"), ("supplier", ""), ("src/nation_7",)),
    (2, "ANALYSIS", ("red", "MOROCCO"), ("", ""), ()),
    (3, "OPTIMIZATION", ("customers", "steel"), ("customer", ""), ("lib/FRANCE", "FRANCE")),
)
_ASKED_WORDS = ", ".join(f"({q}, '{w.lower()}', '{t}')" for q, _, words, stems, _ in GRAPH_ASKED for w, t in zip(words, stems, strict=True))
_ASKED_PATHS = ", ".join(f"({q}, '{p}')" for q, *_, paths in GRAPH_ASKED for p in paths)


def graph_questions(spark):
    rows = [(q, kind, list(words), list(paths)) for q, kind, words, _, paths in GRAPH_ASKED]
    return spark.createDataFrame(rows, "qid int, kind string, words array<string>, scope array<string>")


@query("g08_seeds", f"{G}, {_TOKENS}, kw(qid, w, s) AS (VALUES {_ASKED_WORDS}), sp(qid, p) AS (VALUES {_ASKED_PATHS}), m AS (SELECT DISTINCT qid, token FROM (SELECT DISTINCT token FROM tokens) JOIN kw ON contains(token, w) OR (s <> '' AND (contains(token, s) OR contains(s, token)))) SELECT qid, id FROM m JOIN tokens USING (token) UNION SELECT qid, min(id) FROM nodes JOIN sp ON name = p OR ends_with(name, '/' || p) OR ends_with(p, name) WHERE type = 'FILE' GROUP BY qid, p")
def _(spark, d):
    nodes = X.nodes(spark, d)
    return rank.seeds(nodes, lookups.name_tokens(nodes), graph_questions(spark))


@query("g10_configs", f"{G}, q(qid, kind) AS (VALUES {', '.join(f'({q}, {k!r})' for q, k, *_ in GRAPH_ASKED)}), s(kind, configs) AS (VALUES {', '.join(f'({k[0]!r}, {k[3]})' for k in task.STRATEGIES)}) SELECT qid, id FROM q JOIN s USING (kind) JOIN nodes ON configs AND type = 'CONFIG'")
def _(spark, d):
    return rank.configs(X.nodes(spark, d), task.with_strategy(graph_questions(spark)))


_NODE_WANTED = f"kq(qid, word) AS (VALUES {', '.join(f'({q}, {w!r})' for q, _, words, *_ in GRAPH_ASKED for w in words)}), kc AS (SELECT *, {T.cut_sql('word')} AS cut FROM kq), nw AS (SELECT qid, term, 1 + least(length(term), 12) / 12.0::DOUBLE AS w FROM (SELECT DISTINCT qid, {T.bucket_sql('word', 'cut')} AS term FROM kc)), nmost AS (SELECT qid, sum(w) AS most FROM nw GROUP BY qid), nmatch AS (SELECT qid, id, sum(w) / any_value(most) AS match FROM (SELECT id, lower(concat_ws(' ', name, regexp_replace(coalesce(metadata, ''), '\"[^\"]*\"\\s*:', '', 'g'))) AS t FROM nodes WHERE type <> 'FILE') JOIN nw ON contains(t, term) JOIN nmost USING (qid) GROUP BY qid, id)"


def node_matches(spark, d):
    questions = graph_questions(spark).select("qid", F.col("words").alias("terms"))
    return rank.node_match(X.nodes(spark, d).filter("type <> 'FILE'"), questions)


@query("g13_node_match", f"{G}, {_NODE_WANTED} SELECT qid, id, round(match, 6) AS match FROM nmatch")
def _(spark, d):
    return node_matches(spark, d).select("qid", "id", F.round("match", 6).alias("match"))


_RISKS = "CASE hash_risk WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.0 END"
_TYPE_WEIGHT = "(VALUES " + ", ".join(f"('{k}', '{t}', {w}::DOUBLE)" for k, t, w in rank.TYPE_WEIGHTS) + ") AS tw(kind, type, tw)"


@query("g19_score_nodes", f"{G}, {_NODE_WANTED}, q(qid, kind) AS (VALUES {', '.join(f'({q}, {k!r})' for q, k, *_ in GRAPH_ASKED)}), deg AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT from_node AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_node, 0, 1 FROM edges) GROUP BY id), k AS (SELECT qid, q.kind, n.id, n.type, match, coalesce(o, 0) AS o, coalesce(i, 0) AS i, length(n.id) % 3 AS hash_risk, length(n.id) % 4 = 0 AS orphan, length(n.id) * 3.0::DOUBLE AS complexity, length(n.id) % 2 = 0 AS off FROM nmatch JOIN nodes n USING (id) JOIN q USING (qid) LEFT JOIN deg USING (id)), s AS (SELECT k.*, ((1.5 + 0.5::DOUBLE * least(ln(1 + o), 6.0::DOUBLE) + 0.6::DOUBLE * least(ln(1 + i), 6.0::DOUBLE)) * CASE WHEN orphan THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + {_RISKS}::DOUBLE) * coalesce(tw, 1.0::DOUBLE) + least(complexity / 50.0::DOUBLE, 1.0::DOUBLE) AS structure FROM k LEFT JOIN {_TYPE_WEIGHT} USING (kind, type)) SELECT qid, id, round((15.0::DOUBLE * match + structure + CASE type WHEN 'CLASS' THEN 0.7::DOUBLE WHEN 'FUNCTION' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN off AND type IN ('FUNCTION', 'CLASS') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 3) AS score FROM s")
def _(spark, d):
    nodes, edges = X.graph(spark, d)
    found = node_matches(spark, d).join(nodes, "id").join(F.broadcast(graph_questions(spark).select("qid", "kind")), "qid").join(lookups.degrees(edges), "id", "left")
    n = F.length("id")
    risk = F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low")
    value = rank.score(F.col("source"), F.col("type"), F.col("confidence"), F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0)), F.col("match"), F.col("kind"), risk=risk, orphan=n % 4 == 0, complexity=n * 3.0, off_name=n % 2 == 0)
    return found.select("qid", "id", value.alias("score"))


_PACKED = 400


@query("g29_seeded_pack", f"{G.replace('WITH ', 'WITH RECURSIVE ', 1)}, sd(id, o) AS (VALUES ('nation:3', 1), ('supplier:5', 2)), f AS (SELECT id, min(ROW(ph, o, b)) AS pl FROM (SELECT id, 0 AS ph, o, '' AS b FROM sd UNION ALL SELECT to_node, 1, o, to_node FROM sd JOIN edges ON from_node = sd.id) GROUP BY id), n AS (SELECT id, row_number() OVER (ORDER BY pl, id) AS pos FROM f), ev AS (SELECT id, min(ROW(ph, pos, b)) AS pl FROM (SELECT id, 0 AS ph, pos, '' AS b FROM n UNION ALL SELECT from_node, 2, pos, from_node FROM n JOIN edges ON to_node = n.id) GROUP BY id), r AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY pl, id) AS rank, greatest(1, length(id || ' ' || type || ' ' || name) // 4)::BIGINT AS cost FROM ev JOIN nodes USING (id)), fit AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS used, NULL::VARCHAR AS id UNION ALL SELECT r.rank, CASE WHEN used + cost <= {_PACKED} THEN used + cost ELSE used END, CASE WHEN used + cost <= {_PACKED} THEN r.id END FROM fit JOIN r ON r.rank = fit.rank + 1) SELECT id, rank::INTEGER AS rank FROM fit WHERE id IS NOT NULL")
def _(spark, d):
    start = spark.createDataFrame([(1, "nation:3", 1), (1, "supplier:5", 2)], "qid int, id string, ord int")
    return rank.seeded_pack(*X.graph(spark, d), start, _PACKED).select("id", "rank")


@query("f03_naming_groups", f"WITH {X.PART_FILES_SQL}, b AS (SELECT path, lower(split_part(list_last(string_split(path, '/')), '.', 1)) AS base, regexp_replace(path, '/?[^/]*$', '') AS dir FROM part_files) SELECT base, count(*) AS files, count(DISTINCT dir) AS folders, min(path) AS first, max(path) AS last FROM b WHERE base NOT IN ('__init__', 'setup', 'conftest', 'index') GROUP BY base HAVING count(DISTINCT dir) > 1")
def _(spark, d):
    return enrich.naming_groups(X.part_files(spark, d))
