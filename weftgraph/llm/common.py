"""Staging of intermediate tables, connected components and joins with hot keys, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.staging import release, shared_dir, stage

__all__ = ["broadcast_if_small", "connected_components", "give_back", "join_hot", "release", "shared_dir", "small_batches", "stage"]


TEXTS = 1_024  # rows of a batch of whole texts that is handed to Python
SMALL = 200_000  # edges up to which one task finds the components; more are joined in rounds
HOT = 10_000  # a key is hot if it holds more than this part of all rows, so there are fewer than HOT of them


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Bounds the batches of whole texts that Python workers hold; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns what a Python worker has freed to the system. Workers are kept from one operator's tasks to the
    next one's, and freed memory that they hold would stand beside what the next ones need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = 200_000) -> DataFrame:
    """Hints a broadcast only when the counted rows of a slim table stay under the bound;
    beyond it the join shuffles."""
    return F.broadcast(df) if rows <= bound else df


def join_hot(rows: DataFrame, of: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """rows joined with `of`, which has one row for each key and, in `times`, how many rows the key has
    among `total`. Hot keys, fewer than HOT by their definition, are broadcast; the others, of which none
    holds more than a small part of all rows, are joined by a shuffle."""
    hot = F.col(times) * HOT > total
    heavy, light = of.filter(hot), of.filter(~hot)
    apart = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(apart.join(light, keys))


def _components_of_few(edges: DataFrame) -> DataFrame:
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, before[i], low)
            np.minimum.at(root, before[j], low)
            root = root[root]
            if (root == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    return edges.repartition(1).mapInArrow(roots, "node long, root long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root being the smallest node
    that can be reached. Nodes without an edge to another node are absent.

    Few edges are united in one task. More alternate large-star and small-star steps (Kiveris et al.,
    "Connected Components in MapReduce and Beyond") until the edges no longer change. Each half step is
    a minimum per node, which is combined before the shuffle, joined back to the edges; a node with very
    many neighbours is never collected, and the join may be split by the skew handling of AQE.
    """
    return _rounds(stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc"), SMALL)


def _rounds(edges: DataFrame, small: int) -> DataFrame:
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state[0] <= small:
            return _components_of_few(edges)
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        large = stage(large, "cc")
        release(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(least, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stage(small_star, "cc")
        release(large)
