"""Near-duplicate documents: SimHash fingerprints joined exactly by vantage-point trees.

Defined results. A null text is an empty one. A text without words has the fingerprint zero and
is linked like any other. A text with fewer words than a shingle is one shingle. Repeated rows
are rows of their own with one fingerprint; a null id is ignored when the smallest id of a
component is sought, and the component is null only if all its ids are. An empty table gives an
empty result. Columns other than the two named ones are not looked at by ``near_duplicates`` and
are returned untouched by ``keep_one``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, connected_components, join_hot, small_batches, stage

WORDS = 3  # words of a shingle
RADIUS = 2  # bits in which linked fingerprints may differ
SEED = 42
SAMPLE = 32_768  # fingerprints from which the routing tree is built
CELL = 512  # fingerprints wanted in a leaf of the tree
BLOCK = 2_048  # a leaf beyond this is compared in blocks of at most this size
DEEP = 4  # a leaf of more blocks than this gets a tree of its own
PIECE = 65_536  # rows of such a leaf that a task routes at a time
LEAVES = 65_536  # bound of the broadcast tree
_CHUNK = 8_192  # shingles whose bits are counted at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, repeats included; white space and case folding are ASCII."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    hashed, n = xxhash.xxh64_intdigest, len(found) - k + 1
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        h = np.array([hashed(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, fp long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string"))
    return docs.mapInArrow(each, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of unsigned 64-bit values."""
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, total: int, radius: int = RADIUS, cell: int = CELL, leaves: int = LEAVES) -> list[tuple]:
    """A vantage-point tree over sampled fingerprints as a list of nodes (vantage, threshold, inner, outer);
    a leaf has vantage None.

    An inner node sends a fingerprint with d <= threshold + radius inwards and one with
    d > threshold outwards. Of two fingerprints within the radius of each other, either both have
    d > threshold or, by the triangle inequality, both have d <= threshold + radius: each such
    pair meets in some leaf. The threshold halves the node with its boundary counted.
    """
    rng, nodes = np.random.default_rng(7), []
    scale = max(1.0, total / max(1, len(sample)))

    def grow(points: np.ndarray, allowed: int) -> int:
        at = len(nodes)
        nodes.append((None, 0, -1, -1))
        if len(points) * scale <= cell or len(points) < 8 or allowed < 2:
            return at
        best = None
        for v in points[rng.integers(0, len(points), 8)]:
            counts = np.cumsum(np.bincount(distance(points, v), minlength=65 + radius))
            larger = [max(counts[t + radius], counts[-1] - counts[t]) for t in range(64)]
            t = int(np.argmin(larger))
            if best is None or larger[t] < best[0]:
                best = (larger[t], v, t)
        if best[0] > 0.9 * len(points):
            return at
        _, v, t = best
        d = distance(points, v)
        inner = grow(points[d <= t + radius], allowed // 2)
        outer = grow(points[d > t], allowed - allowed // 2)
        nodes[at] = (np.uint64(v), t, inner, outer)
        return at

    grow(sample, leaves)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index into fps and leaf, for every leaf that a fingerprint belongs to."""
    index, leaf, stack = [], [], [(0, np.arange(len(fps)))]
    while stack:
        at, own = stack.pop()
        v, t, inner, outer = nodes[at]
        if not len(own):
            continue
        if v is None:
            index.append(own)
            leaf.append(np.full(len(own), at))
            continue
        d = distance(fps[own], v)
        stack += [(inner, own[d <= t + radius]), (outer, own[d > t])]
    return (np.concatenate(index), np.concatenate(leaf)) if index else (np.zeros(0, int), np.zeros(0, int))


def local_roots(fps: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a cell the smallest index it is linked with inside the cell, over any
    number of links. side: -1 where all are compared; else only 0 with 1 (two blocks of a leaf)."""
    n, i_all, j_all = len(fps), [], []
    a = np.arange(n) if side[0] < 0 else np.flatnonzero(side == 0)
    b = np.arange(n) if side[0] < 0 else np.flatnonzero(side == 1)
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(fps[a[at : at + 256], None] ^ fps[None, b]) <= radius)
        i, j = a[at + i], b[j]
        i_all.append(i[i != j])
        j_all.append(j[i != j])
    i, j = np.concatenate(i_all or [np.zeros(0, int)]), np.concatenate(j_all or [np.zeros(0, int)])
    roots = np.arange(n)
    while len(i):
        before = roots.copy()
        np.minimum.at(roots, i, before[j])
        np.minimum.at(roots, j, before[i])
        roots = roots[roots]
        if (roots == before).all():
            break
    return roots


def _grown(rows: DataFrame, sizes: DataFrame, radius: int, cell: int, sample: int, piece: int) -> DataFrame:
    """(leaf, fp, n_before, split): the rows (leaf, fp) of large leaves, each routed through a tree of its leaf,
    which a task grows from a sample of the leaf; rows are routed in pieces, so that no task holds a leaf.
    split is false where a tree has only its root. sizes: leaf, n."""

    def tree_of(f: pd.DataFrame) -> pd.DataFrame:
        nodes = build_tree(np.sort(f["fp"].to_numpy(np.int64)).view(np.uint64), int(f["n"].iloc[0]), radius, cell)
        plain = [(None if v is None else int(v), t, inner, outer) for v, t, inner, outer in nodes]
        return pd.DataFrame({"leaf": f["leaf"].iloc[:1], "n": f["n"].iloc[:1], "tree": [json.dumps(plain)]})

    def through(own: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        nodes = [(None if v is None else np.uint64(v), t, i, o) for v, t, i, o in json.loads(tree["tree"].iloc[0])] if len(tree) else [(None, 0, -1, -1)]
        fps = own["fp"].to_numpy(np.int64)
        i, at = route(fps.view(np.uint64), nodes, radius)
        return pd.DataFrame({"leaf": own["leaf"].to_numpy()[i], "node": at, "fp": fps[i], "n_before": own["n"].to_numpy()[i], "split": len(nodes) > 1})

    sized = rows.join(broadcast_if_small(sizes, sizes.count()), "leaf")
    picked = sized.filter(F.pmod(F.xxhash64("fp", F.lit(17)), F.col("n")) < sample)  # fingerprints of a leaf are different
    trees = picked.groupBy("leaf").applyInPandas(tree_of, "leaf long, n long, tree string")
    pieces = F.ceil(F.col("n") / piece).cast("long")
    trees = trees.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"), "tree")
    sized = sized.withColumn("piece", F.pmod(F.xxhash64("fp", F.lit(23)), pieces))
    routed = sized.groupBy("leaf", "piece").cogroup(trees.groupBy("leaf", "piece")).applyInPandas(through, "leaf long, node long, fp long, n_before long, split boolean")
    return routed.select(F.xxhash64("leaf", "node").alias("leaf"), "fp", "n_before", "split")


def _deep_cells(rows: DataFrame, radius: int, cell: int, block: int, sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """(leaf, lo, hi, side, fp): the cells of large leaves (leaf, fp). Leaves that are still large after
    they were split are split again, until they are small or their fingerprints lie too close to be told apart
    by a vantage point; these are compared in blocks. Two leaves under one hashed name are only compared more."""
    done = None
    while True:
        sizes = stage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "deepsizes")
        grown = stage(_grown(rows, sizes, radius, cell, sample, piece), "deep")
        after = grown.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("n_before").alias("n_before"), F.max("split").alias("split"))
        again = F.col("split") & (F.col("n") > DEEP * block) & (F.col("n") < 0.95 * F.col("n_before"))
        after = stage(after.select("leaf", "n", again.alias("again")), "deepsizes")
        few = broadcast_if_small(after, after.count())
        s = F.ceil(F.col("n") / block).cast("long")
        own = F.pmod(F.xxhash64("fp", F.lit(29)), s)
        ready = grown.join(few.filter(~F.col("again")), "leaf").select("leaf", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), s - 1)).alias("other"))
        ready = ready.select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
        side = F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("own") == F.col("hi")).cast("int"))
        ready = ready.select("leaf", "lo", "hi", side.alias("side"), "fp")
        done = ready if done is None else done.unionByName(ready)
        if after.filter("again").isEmpty():
            return done
        rows = grown.join(few.filter("again").select("leaf"), "leaf", "left_semi").select("leaf", "fp")


def links(fps: DataFrame, total: int, radius: int = RADIUS, cell: int = CELL, block: int = BLOCK, most: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long) whose components are those of all pairs
    within the radius. Each cell gives at most one edge for each of its fingerprints.

    The driver's tree is fitted to a sample of bounded size, so its leaves grow with the corpus; those of
    many blocks get trees of their own on the executors."""
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(most).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = build_tree(sample, total, radius, cell)

    def to_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f["fp"].to_numpy(np.int64).view(np.uint64)
            i, leaf = route(own, nodes, radius)
            yield pd.DataFrame({"leaf": leaf, "fp": own[i].view(np.int64)})

    routed = fps.select("fp").mapInPandas(to_leaves, "leaf long, fp long")
    large = routed.groupBy("leaf").count().filter(F.col("count") > block)
    large = large.select("leaf", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    parts = {r.leaf: r.parts for r in large.collect()}  # at most one row a leaf, and a tree has LEAVES of them
    deep = np.array(sorted(leaf for leaf, n in parts.items() if n > DEEP), np.int64)

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A leaf in s blocks becomes s cells of one block and a cell for each two blocks. Routing is done
        again in the same pass, so that a task keeps one Python worker and not two."""
        for f in to_leaves(frames):
            f = f[~f["leaf"].isin(deep)]
            fp, leaf = f["fp"].to_numpy(np.int64), f["leaf"].to_numpy()
            s = np.array([parts.get(x, 1) for x in leaf.tolist()], np.int64)
            mix = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = ((mix >> np.uint64(33)) % s.astype(np.uint64)).astype(np.int64)
            for other in range(s.max(initial=0)):
                m = other < s
                lo, hi = np.minimum(own[m], other), np.maximum(own[m], other)
                side = np.where(lo == hi, -1, (own[m] == hi).astype(int))
                yield pd.DataFrame({"leaf": leaf[m], "lo": lo, "hi": hi, "side": side, "fp": fp[m]})

    def to_deep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in to_leaves(frames):
            yield f[f["leaf"].isin(deep)]

    def in_cell(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("fp")
        own = f["fp"].to_numpy(np.int64)
        roots = local_roots(own.view(np.uint64), f["side"].to_numpy(), radius)
        m = roots != np.arange(len(own))
        return pd.DataFrame({"a": own[m], "b": own[roots[m]]})

    cells = fps.select("fp").mapInPandas(to_cells, "leaf long, lo long, hi long, side int, fp long")
    if len(deep):
        rows = stage(fps.select("fp").mapInPandas(to_deep, "leaf long, fp long"), "deep")
        cells = cells.unionByName(_deep_cells(rows, radius, cell, block, most, piece))
    return cells.groupBy("leaf", "lo", "hi").applyInPandas(in_cell, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS
) -> DataFrame:
    """(id_col, fp long, component, root) of every row; component is the smallest id that links reach,
    and root the fingerprint that stands for the component, whatever its ids are."""
    rows = stage(with_fingerprints(docs, id_col, text_col, words), "fp")
    fps = stage(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("times")), "fps")
    edges = links(fps, fps.count(), radius)
    return with_components(rows, fps, edges, id_col)


def with_components(rows: DataFrame, fps: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(id_col, fp, component, root) of rows (id_col, fp), given the smallest id and the number of rows of
    each fingerprint in fps (fp, least, times) and the edges (a, b) between fingerprints."""
    members = stage(connected_components(edges), "members")
    per_root = members.join(fps, members.node == fps.fp).groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("size"))
    joined = join_hot(members, per_root, ["root"], "size", members.count()).select(F.col("node").alias("fp"), "component", "root")
    component = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component"))
    of = stage(fps.join(joined, "fp", "left").select("fp", component.alias("component"), F.coalesce("root", "fp").alias("root"), "times"), "of")
    return join_hot(rows, of, ["fp"], "times", rows.count()).select(id_col, "fp", "component", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id stays, of
    rows that repeat it the smallest by its columns in order. All columns are kept.

    Few documents go, so their ids are taken off; only where they outgrow a broadcast are texts
    shuffled. Ids that stand in several rows are decided by id and fingerprint together.
    """
    found = near_duplicates(docs, id_col, text_col, radius, words)
    return keep_least(docs, found, lambda t: fingerprint(t, words), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, print_of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` for components `found` (id_col, fp, component, root); print_of gives a text's fp, unsigned."""
    found = stage(found.withColumnRenamed(id_col, "_id"), "found")
    per_id = found.groupBy("_id").agg(F.count(F.lit(1)).alias("times"), F.min("component").alias("component"))
    goes = per_id.filter((F.col("times") > 1) | ~F.col("_id").eqNullSafe(F.col("component")))
    goes = stage(goes.select("_id", (F.col("times") > 1).alias("repeated")), "goes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.col(f"_row.`{id_col}`")
    once = rows.join(goes, own.eqNullSafe(F.col("_id")), "left_anti").select("_row.*")
    if not goes.filter("repeated").limit(1).count():
        return once

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([print_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    again = rows.join(goes.filter("repeated"), own.eqNullSafe(F.col("_id")), "left_semi").withColumn("_fp", fp_of(F.col(f"_row.`{text_col}`").cast("string")))
    stays = found.filter(F.col("_id").eqNullSafe(F.col("component"))).select("_id", "fp").distinct()
    again = again.join(stays, own.eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("fp")), "left_semi")
    # rows with one id may stay for different components
    of = found.select(F.col("fp").alias("_f"), "root").distinct()
    again = again.join(of, F.col("_fp") == F.col("_f")).groupBy("root").agg(F.min("_row").alias("_row"))
    return once.union(again.select("_row.*"))
