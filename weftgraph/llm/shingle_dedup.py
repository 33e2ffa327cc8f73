"""Near-duplicate documents by the Jaccard similarity of five-word shingles, exact, by SimHash and prefix filtering.

At first the vantage-point trees of ``simhash_dedup`` join the SimHash fingerprints of the sets of
shingles; the pairs that they link are compared as whole sets, and those that are similar enough are
united. No radius at which trees prune holds all similar pairs (one of 0.8 differs in 3 to 12 bits), so a
second step finds every similar pair that the first one left in different components, as follows.

The shingles of all texts are brought into one order, rare ones first. Two sets whose similarity is
at least t share a shingle among the first n - ceil(t n) + 1 of each, so an equality join on these
prefixes meets every such pair; sizes and the places of the shared shingle rule out most others
(Chaudhuri et al., "A Primitive Operator for Similarity Joins in Data Cleaning"; Xiao et al.,
"Efficient Similarity Joins for Near Duplicate Detection"). Of the pairs that meet, parities of the
shingles at hashed places rule out those that must differ in too many (Sandes et al., "Bitmap Filter:
Speeding up Exact Set Similarity Joins with Bitwise Operations"). What is left is compared as whole sets.
Which shingles are frequent is sampled; the order decides about speed, not about the result.

Defined results. Words are lower-cased and parted at ASCII white space. Shingles stand for themselves by
64-bit hashes. A null text is an empty one; texts without words are linked with each other. A text
of fewer than five words is one shingle. Repeated rows and null ids are treated as in
``simhash_dedup``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import simhash_dedup
from weftgraph.llm.common import broadcast_if_small, connected_components, join_hot, release, small_batches, stage
from weftgraph.llm.simhash_dedup import keep_least, with_components

WORDS = 5
#: Least similarity of linked texts, as a fraction.
LEAST = (4, 5)
#: Bits in which fingerprints that the trees link may differ: the most at which trees still prune.
RADIUS = 3
SAMPLE = 8_192  # documents among which frequent shingles are sought at least,
PART = 6  # or one in so many: shingles that are not found then stand in few texts however many there are
FREQUENT = 3  # times that a frequent shingle stands in the sample at least
CROWD = 8  # a shingle of so many sets in several components is looked through in random order before all its pairs are
PARTNERS = 4  # sets that each is then compared with in a turn
TURNS = 2
SKETCH = ("s0", "s1", "s2", "s3")
LISTED = 2_000_000  # bound of the broadcast list of frequent shingles, 32 MB
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as ascending 64-bit hashes."""
    words, hashed = (text or "").lower().encode("utf-8", "surrogatepass").split(), xxhash.xxh3_64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(h))
    terms = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        terms = (terms ^ h[j : len(h) - k + 1 + j]) * _MIX[j]
        terms ^= terms >> np.uint64(32)
    return np.unique(terms)


def parities(own: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each of 2 n to 4 n places, a power of two and 64 at least.
    Two sets that differ in d shingles have parities that differ in d places at most."""
    places = 1 << max(6, (2 * len(own) - 1).bit_length())
    hits = np.bincount((own >> np.uint64(7)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(hits.astype(np.uint8)).tobytes()


def sketch(own: np.ndarray) -> np.ndarray:
    """The parities on as many places for all sets, as four words that may go along with each shingle."""
    hits = np.bincount((own >> np.uint64(7)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(hits.astype(np.uint8)).view(np.int64)


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ, from their parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):  # places that agree in the lower bits become one
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def simhash(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set: the bits that are 1 in over half of its shingles."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), 8_192):
        votes += np.unpackbits(own[at : at + 8_192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(own), bitorder="little").view("<u8")[0])


def digest(own: np.ndarray) -> int:
    """64 bits that stand for a set of shingles."""
    return xxhash.xxh3_64_intdigest(own.tobytes())


def print_of(text: str | None) -> int:
    return digest(shingles(text))


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles, by their counts among the (ascending) frequent ones, then by hash."""
    n = len(own)
    size = n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0
    if not len(frequent):
        return own[:size]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    weight = np.where(frequent[at] == own, counts[at], 0)
    return own[np.argsort(weight, kind="stable")[:size]]


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample in ascending order, and their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t) for t in b.column(0).to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["shingle"])

    share = min(1.0, max(SAMPLE / max(1, docs.count()), 1 / PART))
    texts = docs.select(F.col(f"`{text_col}`").cast("string")).sample(share, 7)
    found = texts.mapInArrow(each, "shingle long").groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    found = found.orderBy(F.col("count").desc(), "shingle").limit(LISTED).toPandas()
    hashes = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(np.int64)[order]


def _filters(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the sizes, and the shingles that are left from the shared one on, leave room for the similarity."""
    over, under = LEAST
    return (under * F.least(a["n"], b["n"]) >= over * F.greatest(a["n"], b["n"])) & _enough(F.least(a["rest"], b["rest"]), a["n"], b["n"])


def _enough(common: Column, n: Column, m: Column) -> Column:
    over, under = LEAST
    return (over + under) * common >= over * (n + m)


def _near(apart, n, m):
    """Whether sets of n and m shingles that differ in `apart` at least may be similar enough: their common
    part is half of what the sizes together exceed the difference by."""
    over, under = LEAST
    return (over + under) * (n + m - apart) >= 2 * over * (n + m)


def with_neighbours(places: DataFrame, by: Column) -> DataFrame:
    """The places (shingle, fp, ..., all long) that share their shingle with another place, each with the
    first place of its shingle (first_fp, ...) and the one before it (before_fp, ...; itself if there is
    none), the places of a shingle being ordered by `by`.

    They are sorted into ranges, so a shingle of very many sets spans many tasks, and "first" means the first
    of a range. The first and the last place of a range stay in any case, as the next range may hold their shingle.
    """
    columns = places.columns
    names = [*columns, *[f"{side}_{x}" for side in ("first", "before") for x in columns[1:]]]

    def out(own: np.ndarray, first: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*own.T, *first.T[1:], *before.T[1:])], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = head = before_held = None  # the last place so far, not yet given out, its shingle's first, the one before it
        edge = shared = True  # whether the held place is the range's first, and whether the one before shares its shingle
        for b in batches:
            new = np.stack([c.to_numpy() for c in b.columns[: len(columns)]], axis=1)
            if not len(new):
                continue
            if held is None:
                rows, starts_edge = new, True
                first0, before0, shared0 = new[0], new[0], False
            else:
                rows, starts_edge = np.concatenate([held[None], new]), edge
                first0, before0, shared0 = head, before_held, shared
            same = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0]])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
            first = rows[start]
            first[start == 0] = first0
            before = np.where(same[:, None], np.concatenate([rows[:1], rows[:-1]]), rows)
            before[0] = before0
            with_before = same.copy()
            with_before[0] = shared0
            stays = with_before[:-1] | same[1:]
            if len(rows) > 1:
                stays[0] |= starts_edge
                yield out(rows[:-1][stays], first[:-1][stays], before[:-1][stays])
            held, head, before_held, shared = rows[-1], first[-1], before[-1], bool(with_before[-1])
            edge = starts_edge and len(rows) == 1
        if held is not None:
            yield out(held[None], head[None], before_held[None])

    keyed = places.withColumn("_by", by)
    ranged = keyed.repartitionByRange("shingle", "_by").sortWithinPartitions("shingle", "_by")
    return ranged.mapInArrow(each, ", ".join(f"{x} long" for x in names))


def by_trees(sets: DataFrame, radius: int | None = None) -> DataFrame:
    """Pairs (fp, other) of different sets (fp, simhash) whose components are those of all sets with
    fingerprints within the radius: each set with the first of its fingerprint, and the first ones of the
    fingerprints that the vantage-point trees link."""
    firsts = stage(sets.groupBy("simhash").agg(F.min("fp").alias("other"), F.count(F.lit(1)).alias("times")), "firsts")
    total = firsts.count()
    near = stage(simhash_dedup.links(firsts.select(F.col("simhash").alias("fp")), total, RADIUS if radius is None else radius), "near")
    near = broadcast_if_small(near, near.count())
    a, b = (firsts.select(F.col("simhash").alias(side), F.col("other").alias(x)) for side, x in (("a", "fp"), ("b", "other")))
    across = near.join(a, "a").join(b, "b").select("fp", "other")
    shared = firsts.filter("times > 1")
    alike = join_hot(sets.select("fp", "simhash"), shared, ["simhash"], "times", total).filter("fp <> other")
    return stage(across.union(alike.select("fp", "other")), "trees")


def links(docs: DataFrame, rows: DataFrame, bits: DataFrame, fps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between different sets of rows (fp, n, prefix), one for each fp, whose components are
    those of all pairs that are similar enough; bits (fp, n, bits, simhash) has each set's parities and
    fingerprint, fps the smallest id (least) of each fp.

    The pairs that the trees link are compared first. Within a large group of near copies not all pairs are
    compared: of what the trees left apart, at first each set is compared with
    one or two that it shares a shingle with, then each shingle's sets with the first of them and the one
    before, then those of crowded shingles with others in random order. Only pairs that these links leave in
    different components are compared all, and those of a shingle's largest component only with sets outside it.
    """
    linked = by_trees(bits)
    places = rows.select("fp", "n", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "fp", "n", (F.col("n") - F.col("at")).alias("rest"))
    shared = stage(with_neighbours(places, F.col("fp")), "shared")
    release(rows)
    own, stars = {c: F.col(c) for c in ("n", "rest")}, []
    for side in ("first", "before"):
        head = {c: F.col(f"{side}_{c}") for c in ("fp", "n", "rest")}
        fits = shared.filter((F.col("fp") != head["fp"]) & _filters(own, head))
        stars.append(fits.select("fp", head["fp"].alias("other"), F.lit(side).alias("side")))
    stars = stage(stars[0].union(stars[1]).distinct(), "stars")
    found = members = None

    def unite(pairs: DataFrame) -> None:
        nonlocal found, members
        pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
        if members is not None:  # those that are already in one component say nothing new
            a, b = (members.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")) for side in "ab")
            apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
            pairs = pairs.join(a, "a", "left").join(b, "b", "left").filter(apart).select("a", "b")
        pairs = stage(pairs, "pairs")
        new = alike(pairs, bits, docs, fps, id_col, text_col)
        found = new if found is None else stage(found.union(new), "edges")
        before, members = members, stage(connected_components(found), "parts")
        release(pairs, before)

    def rooted() -> DataFrame:
        own = shared.select("shingle", "fp", "n", "rest").join(members.withColumnRenamed("node", "fp"), "fp", "left")
        return stage(own.withColumn("root", F.coalesce("root", "fp")), "rooted")

    unite(linked)
    release(linked)
    unite(stars.groupBy("fp", "side").agg(F.min("other").alias("other")))
    unite(stars)
    release(stars)
    for turn in range(TURNS):
        places = rooted()
        crowded = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter((F.col("sets") >= CROWD) & (F.col("lo") != F.col("hi")))
        crowded = stage(places.join(crowded.select("shingle"), "shingle", "left_semi"), "crowded")
        release(places)
        if crowded.isEmpty():
            break
        met = with_neighbours(crowded, F.xxhash64("shingle", "fp", F.lit(turn)))
        head = {c: F.col(f"before_{c}") for c in ("n", "rest")}
        met = met.filter((F.col("root") != F.col("before_root")) & _filters(own, head)).groupBy("fp").agg(F.slice(F.sort_array(F.collect_set("before_fp")), 1, PARTNERS).alias("o"))
        unite(met.select("fp", F.explode("o").alias("other")))
        release(crowded)
    places = rooted()
    release(shared)
    per_root = places.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("times"))
    mixed = per_root.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("times", "root")).alias("major")).filter("roots > 1").drop("roots")
    open_ = stage(places.join(mixed, "shingle").join(bits.select("fp", *SKETCH), "fp"), "open")
    release(places)
    left, right = (open_.select("shingle", "major", *[F.col(x).alias(f"{side}_{x}") for x in ("fp", "n", "rest", "root", *SKETCH)]) for side in "ab")
    a, b = ({x: F.col(f"{side}_{x}") for x in ("n", "rest")} for side in "ab")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in SKETCH])
    fits = _filters(a, b) & _near(apart.cast("long"), a["n"], b["n"])
    met = left.filter("a_root <> major").join(right.drop("major"), "shingle").filter((F.col("a_root") != F.col("b_root")) & fits)
    rest = stage(met.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct(), "pairs")
    release(open_)
    return found.union(alike(rest, bits, docs, fps, id_col, text_col))


def may_be_alike(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) without those that parities show to differ in too many shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            apart = np.fromiter(map(least_apart, b.column(3).to_pylist(), b.column(5).to_pylist()), np.int64, len(n))
            fits = _near(apart, n, m)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fits)), b.column(1).filter(pa.array(fits))], names=["a", "b"])

    a, b = (bits.select(F.col("fp").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")) for side in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    return both.mapInArrow(each, "a long, b long")


def alike(pairs: DataFrame, bits: DataFrame, docs: DataFrame, fps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    pairs = stage(may_be_alike(pairs, bits), "likely")
    nodes = stage(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "nodes")
    nodes = broadcast_if_small(nodes, nodes.count())
    ids = stage(fps.join(nodes, "fp", "left_semi").select(F.col("least").alias("_least")).distinct(), "ids")
    ids = broadcast_if_small(ids, ids.count())  # else all texts are shuffled

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t) for t in b.column(0).to_pylist()]
            fp = np.array([digest(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["fp", "own"])

    texts = docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col("_least")), "left_semi").select(F.col(f"`{text_col}`").cast("string"))
    sets = stage(texts.mapInArrow(each, "fp long, own array<long>").join(nodes, "fp", "left_semi"), "sets")
    a, b = (sets.select(F.col("fp").alias(side), F.col("own").alias(f"{side}_own")) for side in "ab")
    n, m = (F.size(f"{side}_own").cast("long") for side in "ab")
    both = pairs.join(a, "a").join(b, "b")
    found = stage(both.filter(_enough(F.size(F.array_intersect("a_own", "b_own")).cast("long"), n, m)).select("a", "b"), "alike")
    release(sets)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long, component, root) of every row, as ``simhash_dedup.near_duplicates`` has them; fp
    stands for the set of shingles."""
    small_batches(docs.sparkSession)
    frequent, counts = _frequent(docs, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t) for t in b.column(1).to_pylist()]
            fp = np.array([digest(x) for x in own], np.uint64).view(np.int64)
            first = pa.array([prefix(x, frequent, counts).view(np.int64) for x in own], pa.list_(pa.int64()))
            bits = pa.array([parities(x) for x in own], pa.binary())
            words = np.stack([sketch(x) for x in own], axis=1) if own else np.zeros((4, 0), np.int64)
            sim = np.array([simhash(x) for x in own], np.uint64).view(np.int64)
            columns = [b.column(0), pa.array(fp), pa.array([len(x) for x in own], pa.int64()), first, bits, pa.array(sim), *map(pa.array, words)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fp", "n", "prefix", "bits", "simhash", *SKETCH])

    own = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string"))
    rows = own.mapInArrow(each, f"`{id_col}` {own.schema[0].dataType.simpleString()}, fp long, n long, prefix array<long>, bits binary, simhash long, {', '.join(f'{x} long' for x in SKETCH)}")
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "shingles")
    slim = stage(rows.select(id_col, "fp"), "ids_of_sets")
    fps = stage(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("times")), "fps")
    repeats = rows.select("rid").join(fps.select("rid"), "rid", "left_anti")
    once = rows.join(broadcast_if_small(repeats, rows.count() - fps.count()), "rid", "left_anti")
    bits = stage(once.select("fp", "n", "bits", "simhash", *SKETCH), "bits")
    once = stage(once.select("fp", "n", "prefix"), "sets_once")
    release(rows)
    edges = links(docs, once, bits, fps, id_col, text_col)
    release(bits)
    return with_components(slim, fps, edges, id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates, chosen as in ``simhash_dedup.keep_one``."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), print_of, id_col, text_col)
