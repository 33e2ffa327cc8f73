"""Near-duplicate embeddings: an exact metric range join by pivots.

The angle between vectors is a metric, and cosine >= c is an angle <= r. Pivots cut the vectors into
cells, each vector going to its nearest pivot. By the triangle inequality a vector x can only have
partners in cell j if its angle to pivot j is at most R_j + r, R_j being the cell's radius, and at
most its angle to its own pivot + 2 r; x is sent to those cells only. Cells that are still large are
cut into blocks of bounded size, and each two blocks that may hold partners are compared by
themselves: a task holds two blocks, however hot a cell is.

How far pivots prune depends on the data: vectors without cluster structure in many dimensions all
lie about equally far from each pivot, and then all blocks meet.

Defined results. Vectors that are null, empty or zero, or hold a null or non-finite component link
with nothing and are components of their own. Vectors of different length never link. Equal vectors
are compared once and counted each. Rows that repeat an id are vectors of their own; null ids are
ignored when a component's smallest id is sought. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import connected_components, join_hot, stage

COSINE = 0.95
BLOCK = 4_096  # most vectors of a block, on average
PIVOTS = 256  # most pivots of vectors of one length
SAMPLE = 4_096  # vectors from which pivots are chosen
_TILE = 1_024
_SLACK = 1e-4  # below the threshold by which single precision preselects


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector with the largest angle to those before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-12:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def compare(a: np.ndarray, b: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with cosine at least the given one; within a, i < j, if b is None.
    Single precision preselects with a margin, double precision decides."""
    other = a if b is None else b
    fa, fb = a.astype(np.float32), other.astype(np.float32)
    for at in range(0, len(a), _TILE):
        for to in range(at if b is None else 0, len(other), _TILE):
            i, j = np.nonzero(fa[at : at + _TILE] @ fb[to : to + _TILE].T >= cosine - _SLACK)
            if b is None and to == at:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            rows, cols = np.unique(i), np.unique(j)
            exact = a[at + rows] @ other[to + cols].T
            sure = exact[np.searchsorted(rows, i), np.searchsorted(cols, j)] >= cosine
            yield at + i[sure], to + j[sure]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    radius = math.acos(cosine) + 1e-9
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(good, F.lit(False)).alias("good"), v.alias("v"), F.monotonically_increasing_id().alias("rid")
    )
    # 128 bits stand for the vector; -0.0 and 0.0 hash alike after the addition
    v = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("h1", F.when(F.col("good"), F.xxhash64(v)).otherwise(F.col("rid"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit("2"), v)))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["v"] = [None if x is None else np.asarray(x, "<f8").tobytes() for x in f["v"]]
            yield f

    slim = rows.select("id", "good", "h1", "h2", F.when(F.col("good"), F.col("v")).alias("v"))
    slim = slim.mapInPandas(packed, f"id {slim.schema[0].dataType.simpleString()}, good boolean, h1 long, h2 long, v binary")
    rows = stage(slim, "vectors")
    distinct = rows.filter("good").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"), F.min("id").alias("least"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", (F.length("v") / 8).cast("int")), "distinct")

    firsts = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2", "v")).alias("first")).collect()  # a row for each length
    pivots = {r.dim: choose_pivots(_unit([r.first.v]), 1) for r in firsts}
    for dim, n in ((r.dim, r.n) for r in firsts if r.n > block):
        sample = distinct.filter(F.col("dim") == dim).orderBy("h1", "h2").limit(SAMPLE).select("v").toPandas()
        pivots[dim] = choose_pivots(_unit(sample["v"].tolist()), min(PIVOTS, -(-n // block)))

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, own in f.groupby("dim"):
                near = angles(_unit(own["v"].tolist()), pivots[dim])
                cell = near.argmin(axis=1)
                yield pd.DataFrame({"dim": own["dim"], "cell": cell, "angle": near[np.arange(len(own)), cell]})

    sizes = distinct.select("dim", "v").mapInPandas(homes, "dim int, cell int, angle double").groupBy("dim", "cell")
    sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()  # a row for each pivot
    reach = {(r.dim, r.cell): r.r for r in sizes}
    parts = {(r.dim, r.cell): max(1, round(r.n / block)) for r in sizes}

    def to_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each pair of blocks that the vector takes part in. Blocks are numbered over the cells."""
        for f in frames:
            for dim, own in f.groupby("dim"):
                cells = sorted(c for d, c in parts if d == dim)
                first = dict(zip(cells, np.cumsum([0] + [parts[dim, c] for c in cells]).tolist(), strict=False))
                near = angles(_unit(own["v"].tolist()), pivots[dim])
                cell = near.argmin(axis=1)
                at_home = near[np.arange(len(own)), cell]
                mix = (own["h2"].to_numpy(np.int64).view(np.uint64) >> np.uint64(20)).astype(np.int64)
                mine = np.array([first[c] for c in cell.tolist()]) + mix % np.array([parts[dim, c] for c in cell.tolist()])
                for c in cells:
                    sent = (cell == c) | ((near[:, c] <= reach[dim, c] + radius) & (near[:, c] <= at_home + 2 * radius))
                    own_sent, block_sent = own[sent], mine[sent]
                    for other in range(first[c], first[c] + parts[dim, c]):
                        lo, hi = np.minimum(block_sent, other), np.maximum(block_sent, other)
                        yield pd.DataFrame({"dim": own_sent["dim"], "lo": lo, "hi": hi, "side": np.where(lo == hi, 0, (block_sent == hi).astype(int)), "node": own_sent["node"], "times": own_sent["times"], "v": own_sent["v"]})

    def in_pair(f: pd.DataFrame) -> pd.DataFrame:
        """Links of each vector to others of the pair of blocks, and the smallest node reached inside it."""
        f = f.sort_values(["side", "node"])
        x, times, node, side = _unit(f["v"].tolist()), f["times"].to_numpy(), f["node"].to_numpy(), f["side"].to_numpy()
        cut = len(f) if f["lo"].iloc[0] == f["hi"].iloc[0] else int(np.searchsorted(side, 1))
        one_block = f["lo"].iloc[0] == f["hi"].iloc[0]
        n, roots = np.zeros(len(f), np.int64), np.arange(len(f))

        def top(k: int) -> int:
            while roots[k] != k:
                roots[k] = roots[roots[k]]
                k = roots[k]
            return k

        if one_block or 0 < cut < len(f):
            for i, j in compare(x[:cut], None if one_block else x[cut:], cosine):
                j = j if one_block else j + cut
                np.add.at(n, i, times[j])
                np.add.at(n, j, times[i])
                # a pair within one known tree says nothing new
                for a, b in zip(i[(apart := roots[i] != roots[j])].tolist(), j[apart].tolist(), strict=True):
                    a, b = top(a), top(b)
                    if a != b:
                        roots[max(a, b)] = min(a, b)
                while (roots != roots[roots]).any():
                    roots = roots[roots]
        m = n > 0
        return pd.DataFrame({"node": node[m], "n": n[m], "root": node[roots[m]]})

    pairs = distinct.select("dim", "node", "times", "h2", "v").mapInPandas(to_pairs, "dim int, lo int, hi int, side int, node long, times long, v binary")
    found = stage(pairs.groupBy("dim", "lo", "hi").applyInPandas(in_pair, "node long, n long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    members = stage(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "members")
    least = members.join(distinct.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    members = members.join(least, "root").select("node", "component")
    of = distinct.select("node", "h1", "h2", "times", "least").join(counts, "node", "left").join(members, "node", "left")
    of = of.select("h1", "h2", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    of, same = stage(of, "of"), rows.filter("good")
    joined = join_hot(same, of, ["h1", "h2"], "times", same.count()).select("id", "n_links", "component_id")
    single = rows.filter("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(single).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
