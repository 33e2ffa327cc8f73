"""Steps that the queries over the derived graph share."""

import pytest
from pyspark.sql import functions as F
from weftgraph.operators import lookups, traverse
from weftgraph.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch):
    tags = []
    write = fixtures.stage
    monkeypatch.setattr(fixtures, "stage", lambda df, tag: tags.append((tag, df)) or write(df, tag))
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    return tags


#: Queries over nodes alone.
NODES = ["e14_name_index", "d09_name_search", "g10_configs"]


@pytest.mark.parametrize("name", NODES)
def test_queries_over_nodes_derive_no_edges(spark, monkeypatch, name):
    tags = written(monkeypatch)
    catalog.QUERIES[name](spark, SF).collect()
    assert not tags


#: Queries over edges.
EDGES = ["e24_node_detail"]


@pytest.mark.parametrize("name", EDGES)
def test_pairs_are_made_different_in_bounded_partitions(spark, monkeypatch, name):
    """No task combines line items before they are dealt out, and a task's share has a bound in rows."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 200)
    tags = written(monkeypatch)
    catalog.QUERIES[name](spark, SF).collect()
    (_, edges), = [t for t in tags if t[0] == "edges"]
    n = fixtures.table(spark, SF, "lineitem").count() // 200 + 1
    assert plan(edges).count(f", {n}), REPARTITION_BY_NUM") == 4
    assert "ENSURE_REQUIREMENTS" not in plan(edges.filter("type = 'IMPORTS'")).replace("BroadcastExchange", "")


def test_node_detail_does_not_sort_the_nodes(spark):
    nodes, edges = fixtures.graph(spark, SF)
    assert "SortMergeJoin" not in plan(lookups.node_detail(nodes, edges, "nation:0"))


def test_edges_are_not_shuffled_for_a_small_frontier(spark):
    """e18_upstream and other walks: edges meet the frontier where they are."""
    edges = spark.range(2000).select(F.concat(F.lit("n"), F.col("id")).alias("from_node"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_node"), F.lit("IMPORTS").alias("type"))
    seeds = spark.createDataFrame([("n1999",)], "id string")
    found = traverse.reach(edges, seeds, 2, reverse=True)
    assert sorted((r.id, r.depth) for r in found.collect()) == [("n1997", 2), ("n1998", 1), ("n1999", 0)]
    assert plan(found).count("BroadcastHashJoin [a") + plan(found).count("BroadcastHashJoin [from_node") + plan(found).count("BroadcastHashJoin [to_node") >= 1
    assert "SortMergeJoin [a" not in plan(found)
