"""Point lookups, neighbourhoods and summaries over nodes and edges.

Every function is a declarative plan; equality filters reach the scan. Edges may point at nodes that
do not exist: counts of edges include them, results of nodes do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def get_edges(edges: DataFrame, from_node: str = "", to_node: str = "", type: str = "") -> DataFrame:
    """Edges that meet all filters given; an empty string is no filter."""
    for column, value in (("from_node", from_node), ("to_node", to_node), ("type", type)):
        if value:
            edges = edges.filter(F.col(column) == value)
    return edges


def search_by_name(nodes: DataFrame, part: str, type: str = "") -> DataFrame:
    """Literal, case-sensitive substring; wildcards mean themselves."""
    found = nodes.filter(F.col("name").contains(part))
    return found.filter(F.col("type") == type) if type else found


def find_file(nodes: DataFrame, path: str) -> DataFrame:
    return get_node(nodes, f"file:{path}")


def find_by_type(nodes: DataFrame, type: str) -> DataFrame:
    return nodes.filter(F.col("type") == type)


def find_by_source(nodes: DataFrame, source: str) -> DataFrame:
    return nodes.filter(F.col("source") == source)


def existing(nodes: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The nodes that a column of ids names."""
    return nodes.join(ids.select(F.col(column).alias("_id")), F.col("id") == F.col("_id"), "left_semi")


def dependents(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): incoming imports."""
    own = get_edges(edges, to_node=node_id, type="IMPORTS")
    return existing(nodes, own, "from_node"), own


def imports(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): outgoing imports."""
    own = get_edges(edges, from_node=node_id, type="IMPORTS")
    return existing(nodes, own, "to_node"), own


def all_edges_for(edges: DataFrame, node_id: str) -> DataFrame:
    """Incoming and outgoing edges; an edge from the node to itself counts twice."""
    return get_edges(edges, to_node=node_id).unionByName(get_edges(edges, from_node=node_id))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes named by ids (id), and edges with both ends among the ids."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    inside = edges.join(ids, F.col("from_node") == F.col("_id"), "left_semi").join(ids, F.col("to_node") == F.col("_id"), "left_semi")
    return nodes.join(ids, F.col("id") == F.col("_id"), "left_semi"), inside


def edge_type_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def language(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.language"), F.lit("unknown"))


def language_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(language(F.col("metadata")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), by edge rows. One shuffle: both ends are counted in one pass."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_node").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_node").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def dependency_snapshot(edges: DataFrame, ids: DataFrame, direct: int = 50, around: int = 20) -> DataFrame:
    """(kind, rank, other): for selected ids the direct edges' targets, and the nodes one hop up and
    down, each the first so many in order."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    out = edges.join(ids, F.col("from_node") == F.col("_id"), "left_semi")
    into = edges.join(ids, F.col("to_node") == F.col("_id"), "left_semi")

    def first(df: DataFrame, kind: str, n: int) -> DataFrame:
        # a bounded top list before the ranks, so that the window sees n rows
        return df.orderBy("other").limit(n).select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy("other")).alias("rank"), "other")

    pairs = out.select(F.concat_ws(">", "from_node", "to_node", "type").alias("other"))
    return first(pairs, "direct", direct).union(first(into.select(F.col("from_node").alias("other")).distinct(), "upstream", around)).union(first(out.select(F.col("to_node").alias("other")).distinct(), "downstream", around))


def critical_edges(edges: DataFrame, ids: DataFrame, n: int = 50) -> DataFrame:
    """Edges between selected ids, the first n in order."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    both = edges.join(ids, F.col("from_node") == F.col("_id"), "left_semi").join(ids, F.col("to_node") == F.col("_id"), "left_semi")
    return both.orderBy("from_node", "to_node", "type").limit(n)


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str, n: int = 15) -> DataFrame:
    """(side, other, name, type, total): up to n dependencies and dependents with the number of all;
    a missing node is named by the last part of its id."""

    def side(own: DataFrame, label: str, column: str) -> DataFrame:
        own = own.select(F.col(column).alias("other"), F.col("type").alias("edge_type"))
        total = own.agg(F.count(F.lit(1)).alias("total"))
        shown = own.orderBy("other", "edge_type").limit(n)
        # of the nodes only those that are shown reach the join, so no task sorts them
        named = nodes.select(F.col("id").alias("other"), "name").join(F.broadcast(shown.select("other").distinct()), "other", "left_semi")
        shown = shown.join(F.broadcast(named), "other", "left")
        name = F.coalesce("name", F.element_at(F.split("other", "/"), -1))
        return shown.crossJoin(F.broadcast(total)).select(F.lit(label).alias("side"), "other", name.alias("name"), F.col("edge_type").alias("type"), "total")

    return side(get_edges(edges, from_node=node_id), "dependency", "to_node").union(side(get_edges(edges, to_node=node_id), "dependent", "from_node"))


def graph_sample(nodes: DataFrame, edges: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first n nodes by id, and up to min(3 n, 150) edges between them."""
    some = nodes.orderBy("id").limit(n)
    return some, critical_edges(edges, some, min(3 * n, 150))


def find_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """The first FILE node whose name is the path, ends with it, or is a suffix of it."""
    name = F.regexp_replace("name", r"\\", "/")
    target = path.replace("\\", "/")
    fits = (name == target) | name.endswith("/" + target) | F.lit(target).endswith(name)
    return find_by_type(nodes, "FILE").filter(fits).orderBy("id").limit(1)


def file_impact(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(nodes, upstream, downstream): nodes of a file path, with their incoming and outgoing edges."""
    own = nodes.filter(F.get_json_object("metadata", "$.file_path") == path).select(F.col("id").alias("_id"))
    out = edges.join(own, F.col("from_node") == F.col("_id"), "left_semi").agg(F.count(F.lit(1)).alias("downstream"))
    into = edges.join(own, F.col("to_node") == F.col("_id"), "left_semi").agg(F.count(F.lit(1)).alias("upstream"))
    return own.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(into)).crossJoin(F.broadcast(out))


def conflicts_for(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Conflicts (source_a, source_b, ...) of which either side's file is among the ids."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    sides = conflicts.select("*", F.explode(F.array_distinct(F.array(F.concat(F.lit("file:"), "source_a"), F.concat(F.lit("file:"), "source_b")))).alias("_side"))
    return sides.join(ids, F.col("_side") == F.col("_id"), "left_semi").drop("_side").distinct()


def patterns_for(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """Patterns (id, affects array) that affect one of the ids."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    hit = patterns.select("id", F.explode("affects").alias("_a")).join(ids, F.col("_a") == F.col("_id"), "left_semi")
    return patterns.join(hit.select("id").distinct(), "id", "left_semi")


def find_by_keyword(tokens: DataFrame, keyword: str, stem: str) -> DataFrame:
    """Ids of an inverted index (token, id) whose token contains the keyword, or contains or is
    contained in its stem. The word is a literal, so this is a filter of the index, not a join."""
    fits = F.col("token").contains(keyword.lower())
    if stem:
        fits = fits | F.col("token").contains(stem) | F.lit(stem).contains(F.col("token"))
    return tokens.filter(fits).select("id").distinct()


def name_tokens(nodes: DataFrame) -> DataFrame:
    """Inverted index (token, id) of names: the whole, the path's parts, and the last part without a script's ending."""
    name = F.lower(F.regexp_replace("name", r"\\", "/"))
    parts = F.split(name, "/")
    last = F.element_at(parts, -1)
    tokens = F.array_distinct(F.concat(F.array(name, last, F.regexp_replace(last, r"\.(py|js|ts)$", "")), parts))
    return nodes.select(F.explode(tokens).alias("token"), "id").filter("token <> ''")
