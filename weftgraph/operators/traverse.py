"""Traversals as loops over frontiers: each level is one join of the frontier with the edges.

Only the frontier is joined, and what was visited is taken off by an anti join. Each frontier is written to the
shared folder and counted: plans stay short and survive lost executors, and a small one is broadcast, so that the
edges are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.staging import as_few, counted, stage


def _directed(edges: DataFrame, reverse: bool) -> DataFrame:
    a, b = ("to_node", "from_node") if reverse else ("from_node", "to_node")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "type")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth, via, type): every id reached from the seeds (id) over at most `depth` edges, at its
    least depth, with the discovering edge; seeds have depth 0 and no edge. Of several discovering
    edges the least (via, type) counts. Ids need not exist as nodes."""
    steps = _directed(edges, reverse)
    frontier = seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("type")).dropDuplicates(["id"])
    seen = None
    for level in range(1, depth + 1):
        frontier = counted(frontier, "frontier")
        seen = frontier if seen is None else seen.unionByName(frontier)
        if frontier.isEmpty():
            return seen
        found = steps.join(as_few(frontier.select(F.col("id").alias("a")), frontier), "a").groupBy("b").agg(F.min(F.struct("a", "type")).alias("e"))
        found = found.select(F.col("b").alias("id"), F.lit(level).alias("depth"), F.col("e.a").alias("via"), F.col("e.type").alias("type"))
        frontier = found.join(seen.select("id"), "id", "left_anti")
    return frontier if seen is None else seen.unionByName(frontier)


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges): existing nodes within the depth, and all outgoing edges of ids above it."""
    found = reach(edges, seeds, depth)
    inner = found.filter(F.col("depth") < depth).select(F.col("id").alias("from_node"))
    return nodes.join(found.select("id", "depth"), "id"), edges.join(inner, "from_node", "left_semi")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, name, depth, via, edge_type): existing nodes from which the seeds can be reached, seeds excepted."""
    found = reach(edges, seeds, depth, reverse=True).filter("depth > 0").withColumnRenamed("type", "edge_type")
    return nodes.select("id", "name").join(found, "id")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, reverse: bool = False) -> DataFrame:
    """(id, edge_type, depth) without the seeds: downstream, or upstream if reversed."""
    return reach(edges, seeds, depth, reverse).filter("depth > 0").select("id", F.col("type").alias("edge_type"), "depth")


def shortest_path(edges: DataFrame, source: str, target: str, longest: int | None = None) -> DataFrame:
    """(path array<string>): one row, the shortest directed path, of several the least as an array; no
    row if there is none, or none of `longest` edges at most. Each level keeps the least path to each new node, so it grows with nodes, not paths."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    if source == target:
        return frontier.select("path")
    steps, seen = _directed(edges, False), frontier.select("id")
    level = 0
    while longest is None or level < longest:
        level += 1
        found = frontier.join(steps, F.col("id") == F.col("a")).groupBy("b").agg(F.min("path").alias("path"))
        found = found.select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        frontier = stage(found.join(seen, "id", "left_anti"), "paths")
        hit = frontier.filter(F.col("id") == target)
        if not hit.isEmpty() or frontier.isEmpty():
            return hit.select("path")
        seen = seen.union(frontier.select("id"))
    return frontier.limit(0).select("path")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(nodes array<string>): the different node sets of directed cycles of 2 nodes or more, sorted; of
    `longest` nodes at most if it is given.

    A path starts at the cycle's least node and goes through larger ones only, so each cycle is found
    from one place; edges that lie on no such path drop out at every join. Without a bound, edges that
    nothing leads to or from are taken off first, and paths grow until none is left: work follows the
    number of simple paths among what cycles join.
    """
    steps = _directed(edges, False).filter("a <> b").select("a", "b").distinct()
    if longest is None:
        steps = _between_cycles(steps)
    paths = steps.filter("b > a").select(F.array("a", "b").alias("path"), F.col("a").alias("first"), F.col("b").alias("last"))
    found, n = None, 2
    while True:
        closed = paths.join(steps, (F.col("last") == F.col("a")) & (F.col("first") == F.col("b")), "left_semi")
        closed = closed.select(F.array_sort("path").alias("nodes"))
        found = closed if found is None else found.union(closed)
        if n == longest:
            break
        grown = paths.join(steps, F.col("last") == F.col("a")).filter((F.col("b") > F.col("first")) & ~F.array_contains("path", F.col("b")))
        paths = grown.select(F.concat("path", F.array("b")).alias("path"), "first", F.col("b").alias("last"))
        n += 1
        if longest is None:
            paths = stage(paths, "cycles")
            if paths.isEmpty():
                break
    return found.distinct()


def _between_cycles(steps: DataFrame) -> DataFrame:
    """The edges (a, b) that lie on a cycle or on a path between cycles."""
    steps = stage(steps, "steps")
    n = steps.count()
    while n:
        inner = steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        steps = stage(inner.join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "steps")
        before, n = n, steps.count()
        if n == before:
            break
    return steps


def circular_dependencies(dependencies: DataFrame, longest: int | None = None) -> DataFrame:
    """(source_a, source_b, category, severity, confidence, description) of import cycles, of any length if no
    bound is given."""
    edges = dependencies.select(F.col("source_file").alias("from_node"), F.col("target").alias("to_node"), F.lit("IMPORTS").alias("type"))
    c = cycles(edges, longest)
    return c.select(
        F.element_at("nodes", 1).alias("source_a"), F.element_at("nodes", -1).alias("source_b"), F.lit("circular_dependency").alias("category"),
        F.lit("high").alias("severity"), F.lit(0.9).alias("confidence"), F.array_join(F.slice("nodes", 1, 5), " -> ").alias("description"),
    )


def related_concepts(edges: DataFrame, seeds: DataFrame, depth: int = 2, prefix: str = "concept:") -> DataFrame:
    """Ids of concepts within forward reach."""
    return reach(edges, seeds, depth).filter(F.col("id").startswith(prefix)).select("id", "depth")


def expand(edges: DataFrame, seeds: DataFrame, up: int, down: int, budget: int) -> DataFrame:
    """(id, depth): the seeds and what lies up to `up` edges before or `down` edges after them, nearest
    first and by id, cut to the budget of nodes."""
    found = reach(edges, seeds, up, reverse=True).select("id", "depth").union(reach(edges, seeds, down).select("id", "depth"))
    return found.groupBy("id").agg(F.min("depth").alias("depth")).orderBy("depth", "id").limit(budget)


def around(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """(qid, id, depth) for seeds (qid, id, up, down, budget): what lies up to `up` edges before or `down`
    edges after a question's seeds, nearest first and by id, cut to each question's budget of nodes. All
    questions walk together, `most` levels at most."""
    start = seeds.select("qid", "id", F.lit(0).alias("depth")).distinct()
    bounds = seeds.groupBy("qid").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.max("budget").alias("budget"))
    every = start
    for reverse, bound in ((True, "up"), (False, "down")):
        steps = _directed(edges, reverse).select("a", "b").distinct()
        frontier, seen = start.select("qid", "id"), start.select("qid", "id")
        for level in range(1, most + 1):
            walks = frontier.join(bounds.filter(F.col(bound) >= level).select("qid"), "qid", "left_semi")
            found = walks.join(steps, F.col("id") == F.col("a")).select("qid", F.col("b").alias("id")).distinct()
            frontier = stage(found.join(seen, ["qid", "id"], "left_anti"), "around")
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
            every = every.union(frontier.withColumn("depth", F.lit(level)))
    nearest = every.groupBy("qid", "id").agg(F.min("depth").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("depth", "id"))
    return nearest.withColumn("_rank", rank).join(bounds, "qid").filter(F.col("_rank") <= F.col("budget")).select("qid", "id", "depth")
