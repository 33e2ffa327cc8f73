"""Set-based mutation of the graph's tables: upserts, deletes, diffs, snapshots.

A store is a directory of immutable snapshots; each mutation is a plan over the last one, and a
commit writes the new tables and then a numbered pointer file; readers follow the largest number.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema


def last_per_key(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Of rows with one key the last by the order column, of equal ones the greatest by its other columns; a
    maximum, so combined before the shuffle."""
    return _extreme(rows, key, F.max_by, order)


def first_per_key(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    return _extreme(rows, key, F.min_by, order)


def _extreme(rows: DataFrame, key: list[str], pick, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    whole = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})  # some columns, such as maps, have no order
    picked = rows.groupBy(*key).agg(pick(F.struct(*rest), F.struct(F.col(order), whole)).alias("_row"))
    return picked.select(*key, "_row.*").select(*rows.columns)


def upsert(table: DataFrame, batch: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Rows of the batch (with an order column) replace rows of their key; in the batch the last wins."""
    fresh = last_per_key(batch, key, order).select(*table.columns)
    return table.join(fresh.select(*key), key, "left_anti").select(*table.columns).unionByName(fresh)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes nodes (id) and the edges at either end."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    kept = nodes.join(ids, F.col("id") == F.col("_id"), "left_anti")
    return kept, edges.join(ids, F.col("from_node") == F.col("_id"), "left_anti").join(ids, F.col("to_node") == F.col("_id"), "left_anti")


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*schema.EDGE_KEY), schema.EDGE_KEY, "left_anti").select(*edges.columns)


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key..., change): 'added', 'updated' or 'deleted'; equal rows are left out. One full outer join."""
    values = [c for c in new.columns if c not in key]
    pack = lambda df, name: df.select(*key, F.struct(F.lit(True).alias("here"), *[F.col(c) for c in values]).alias(name))
    both = pack(old, "_o").join(pack(new, "_n"), key, "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~same, "updated")
    return both.select(*key, change.alias("change")).filter("change IS NOT NULL")


def batch_counts(nodes: DataFrame, edges: DataFrame, upserts: DataFrame, deletes: DataFrame, edge_upserts: DataFrame, edge_deletes: DataFrame) -> DataFrame:
    """One row of what a batch does: nodes and edges added, updated (a key that was there, equal or
    not; repeats count) and removed. Nodes are deleted first, with their edges."""
    left, left_edges = delete_nodes(nodes, edges, deletes)
    gone = nodes.join(deletes.select("id").distinct(), "id", "left_semi")

    def put(table: DataFrame, rows: DataFrame, key: list[str], what: str) -> DataFrame:
        marked = rows.join(table.select(*key, F.lit(1).alias("_old")), key, "left")
        return marked.agg(F.count("_old").alias(f"{what}_updated"), (F.count(F.lit(1)) - F.count("_old")).alias(f"{what}_added"))

    removed = left_edges.join(edge_deletes.select(*schema.EDGE_KEY).distinct(), schema.EDGE_KEY, "left_semi").agg(F.count(F.lit(1)).alias("_r"))
    cascaded = edges.agg(F.count(F.lit(1)).alias("_a")).crossJoin(left_edges.agg(F.count(F.lit(1)).alias("_l")))
    out = gone.agg(F.count(F.lit(1)).alias("nodes_removed"))
    for part in (put(left, upserts, schema.NODE_KEY, "nodes"), put(left_edges, edge_upserts, schema.EDGE_KEY, "edges"), removed, cascaded):
        out = out.crossJoin(part)  # of one row each
    return out.withColumn("edges_removed", F.col("_r") + F.col("_a") - F.col("_l")).drop("_r", "_a", "_l")


def stale_nodes(nodes: DataFrame, fresh: DataFrame, preserved_files: DataFrame, changed: bool = True) -> DataFrame:
    """Nodes that are neither fresh (id) nor belong to a preserved file (id). A symbol belongs to the file
    before `::`. Patterns and conflicts stay only if nothing changed."""
    owner = F.split_part("id", F.lit("::"), F.lit(1))
    left = nodes.join(fresh.select("id"), "id", "left_anti").withColumn("_owner", owner)
    left = left.join(preserved_files.select(F.col("id").alias("_owner")), "_owner", "left_anti").drop("_owner")
    derived = F.col("id").startswith("pattern:") | F.col("id").startswith("conflict:")
    return left if changed else left.filter(~derived)


def stale_edges(edges: DataFrame, fresh: DataFrame, nodes: DataFrame, unreadable: DataFrame, skipped: DataFrame) -> DataFrame:
    """Edges that were not upserted again, whose ends both survive, of which no end is unreadable and
    not both ends were skipped."""
    left = edges.join(fresh.select(*schema.EDGE_KEY), schema.EDGE_KEY, "left_anti")
    for end in ("from_node", "to_node"):
        left = left.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        left = left.join(unreadable.select(F.col("id").alias(end)), end, "left_anti")
    for end, mark in (("from_node", "_f"), ("to_node", "_t")):
        left = left.join(skipped.select(F.col("id").alias(end), F.lit(1).alias(mark)).distinct(), end, "left")
    return left.filter("_f IS NULL OR _t IS NULL").select(*edges.columns)


ABANDONED = 600.0  # seconds after which a claim without its pointer was left by a writer that died


class ConflictError(RuntimeError):
    """Another writer committed first."""


class Lock:
    """A lock file in a folder that all writers see, as a context manager.

    Creating the file without overwriting decides who holds it. A lock older than `stale` seconds was
    left by a writer that died, and is taken over."""

    def __init__(self, spark: SparkSession, folder: str, wait: float = 60.0, stale: float = 6 * 3600.0) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._at, self.wait, self.stale, self.owner = self._path(f"{folder.rstrip('/')}/LOCK"), wait, stale, uuid.uuid4().hex
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def acquire(self) -> bool:
        """Whether the lock is taken now."""
        try:
            out = self._fs.create(self._at, False)
        except Py4JJavaError:
            return self._take_over()
        out.write(bytearray(json.dumps({"owner": self.owner, "time": time.time()}).encode()))
        out.close()
        return True

    def _take_over(self) -> bool:
        try:
            age = time.time() - self._fs.getFileStatus(self._at).getModificationTime() / 1000
        except Py4JJavaError:  # given up meanwhile
            return False
        if age > self.stale and self._fs.rename(self._at, self._path(f"{self._at}-{self.owner}")):
            self._fs.delete(self._path(f"{self._at}-{self.owner}"), False)
        return False

    def release(self) -> None:
        self._fs.delete(self._at, False)

    def __enter__(self) -> Lock:
        until = time.monotonic() + self.wait
        while not self.acquire():
            if time.monotonic() > until:
                raise TimeoutError(f"{self._at} is held by another writer")
            time.sleep(0.2)
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class SnapshotStore:
    """Tables as versioned Parquet snapshots under a root that Spark can read and write.

    A version's tables are all under one name, so they change together. Pointers are numbered: a commit
    creates the next number's file, which fails if another writer did so first, and readers follow the
    largest one. There is no moment without a pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def lock(self, wait: float = 60.0) -> Lock:
        self._fs.mkdirs(self._path(self.root))
        return Lock(self.spark, self.root, wait)

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version) of the commits that are kept, in order."""
        names = [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.root}/CURRENT-*")) or []]
        return sorted((int(n), v) for n, _, v in (name.removeprefix("CURRENT-").partition("-") for name in names))

    def version(self) -> str | None:
        """The current snapshot's name."""
        found = self._pointers()
        return found[-1][1] if found else None

    def table(self, name: str, version: str | None = None) -> DataFrame | None:
        """A table of a snapshot, the current one by default; none if it has no such table."""
        version = version or self.version()
        at = f"{self.root}/{version}/{name}"
        return self.spark.read.parquet(at) if version and self._fs.exists(self._path(at)) else None

    def read(self, version: str | None = None) -> tuple[DataFrame, DataFrame]:
        version = version or self.version()
        if version is None:
            return self.spark.createDataFrame([], schema.NODES), self.spark.createDataFrame([], schema.EDGES)
        tables = [self.spark.read.schema(s).parquet(f"{self.root}/{version}/{t}") for t, s in (("nodes", schema.NODES), ("edges", schema.EDGES))]
        return tables[0], tables[1]

    def commit(self, nodes: DataFrame, edges: DataFrame, tables: dict[str, DataFrame] | None = None) -> str:
        """Writes a snapshot and then its pointer; a failure before leaves the old one current. Of two
        writers that began from one snapshot the later one fails."""
        found = self._pointers()
        number, name = found[-1][0] + 1 if found else 1, f"v{uuid.uuid4().hex}"
        every = {"nodes": nodes.select(*[c.split()[0] for c in schema.NODES.split(", ")]), "edges": edges.select(*[c.split()[0] for c in schema.EDGES.split(", ")])}
        every |= tables or {}
        with ThreadPoolExecutor(len(every)) as pool:  # jobs of their own, so that small tables don't wait for large ones
            put, inherit = lambda table: every[table].write.parquet(f"{self.root}/{name}/{table}"), inheritable_thread_target(self.spark)
            list(pool.map(put if inherit is self.spark else inherit(put), every))
        claim = self._path(f"{self.root}/CLAIM-{number:012d}")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            taken = any(n >= number for n, _ in self._pointers())
            if taken or time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 < ABANDONED:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
                raise ConflictError(f"snapshot {number} of {self.root} was committed by another writer") from e
            # its writer died before the pointer was written
        self._fs.create(self._path(f"{self.root}/CURRENT-{number:012d}-{name}"), False).close()
        return name

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last snapshots; returns how many. Plans that still read older ones fail then."""
        old = self._pointers()[:-keep]
        for number, version in old:
            self._fs.delete(self._path(f"{self.root}/CURRENT-{number:012d}-{version}"), False)
            self._fs.delete(self._path(f"{self.root}/CLAIM-{number:012d}"), False)
            self._fs.delete(self._path(f"{self.root}/{version}"), True)
        return len(old)

    def apply(self, node_upserts: DataFrame | None = None, node_deletes: DataFrame | None = None, edge_upserts: DataFrame | None = None, edge_deletes: DataFrame | None = None) -> str:
        """Node deletes with their edges, node upserts, edge deletes, edge upserts, as one commit."""
        nodes, edges = self.read()
        if node_deletes is not None:
            nodes, edges = delete_nodes(nodes, edges, node_deletes)
        if node_upserts is not None:
            nodes = upsert(nodes, node_upserts, schema.NODE_KEY)
        if edge_deletes is not None:
            edges = delete_edges(edges, edge_deletes)
        if edge_upserts is not None:
            edges = upsert(edges, edge_upserts, schema.EDGE_KEY)
        return self.commit(nodes, edges)


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """Adds the order column that upserts need, from columns of the rows."""
    return rows.withColumn("ord", F.struct(*[F.col(c) for c in by]))


def open_store(spark: SparkSession, root: str, kind: str = "parquet") -> SnapshotStore:
    """The store of a kind; there is one."""
    if kind != "parquet":
        raise ValueError(f"unknown store {kind}")
    return SnapshotStore(spark, root)
