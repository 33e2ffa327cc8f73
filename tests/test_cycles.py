"""Cycles of any length."""

from pyspark.sql import functions as F

from weftgraph.operators import traverse


def test_long_cycles_are_reported(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 7}") for i in range(7)] + [("n2", "n0"), ("n6", "tail"), ("head", "n0"), ("tail", "end"), ("n3", "n3")]
    edges = spark.createDataFrame([(*e, "IMPORTS") for e in ring], "from_node string, to_node string, type string")
    whole, small = [f"n{i}" for i in range(7)], ["n0", "n1", "n2"]
    assert sorted(r.nodes for r in traverse.cycles(edges).collect()) == sorted([small, whole])
    assert [r.nodes for r in traverse.cycles(edges, 4).collect()] == [small]
    assert traverse.cycles(edges.filter("from_node <> 'n2'")).count() == 0 and traverse.cycles(edges.limit(0)).count() == 0
    deps = edges.select(F.col("from_node").alias("source_file"), F.col("to_node").alias("target"))
    assert {(r.source_a, r.source_b) for r in traverse.circular_dependencies(deps).collect()} == {("n0", "n2"), ("n0", "n6")}
