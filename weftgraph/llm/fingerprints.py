"""Document fingerprints: SimHash with weighted terms, and search within a Hamming radius.

Terms are runs of five words. Each different term of a text has a weight that grows with the
logarithm of its count; the bits of its 128-bit hash vote with that weight for or against each bit
of the fingerprint. The share of differing bits estimates the angle between two texts' term
vectors, and likeness is the cosine of that angle, 0 at least. Fingerprints within a radius are
found through permuted block tables: the bits are cut into blocks, and for every choice of
all but `radius` blocks there is a table in which fingerprints that agree on them meet. ``edits`` counts
for each document the different fingerprints within the radius, ``within_radius`` lists the pairs of a
set of queries.

Defined results. A null text is an empty one; a text without words has the fingerprint zero, and
two of them are alike. A text of fewer than five words is one term. Equal texts have equal
fingerprints. Rows that repeat an id are ordered by the first characters of the text (`_HEAD`), then by
a hash of it. The next document of a single row is
itself. Null ids come last. Very long texts are read whole. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from weftgraph.llm.common import broadcast_if_small, join_hot, small_batches, stage

WORDS = 5
BITS = 128
RADIUS = 3  # bits in which fingerprints that are counted as near may differ
BLOCK = 2_048  # fingerprints of a table's cell that are compared at a time
_HEAD = 64
_CHUNK = 16_384
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))


def _scrambled(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(by)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _vote(words: np.ndarray) -> bytes:
    """Fingerprint of a sequence of word hashes."""
    if not len(words):
        return bytes(BITS // 8)
    k = min(WORDS, len(words))
    terms = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        terms = (terms ^ words[j : len(words) - k + 1 + j]) * _MIX[j]
        terms ^= terms >> np.uint64(32)
    terms, counts = np.unique(terms, return_counts=True)
    weights = (1024 * (1 + np.log(counts))).astype(np.int64).astype(np.float64)
    votes = np.zeros(BITS)
    for at in range(0, len(terms), _CHUNK):
        own = terms[at : at + _CHUNK]
        both = np.stack([_scrambled(own, 1), _scrambled(own, 2)], axis=1)
        votes += weights[at : at + _CHUNK] @ np.unpackbits(both.view(np.uint8), axis=1).astype(np.float64)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def fingerprint(text: str | None) -> bytes:
    return _vote(_word_hashes(text or ""))


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal fingerprints."""
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return float(max(0.0, np.cos(np.pi * apart / BITS))) if apart else 1.0


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint binary) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.binary())], names=[id_col, "fingerprint"])

    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string"))
    return docs.mapInArrow(each, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, fingerprint binary")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Each text's fingerprint against that of its edit with the next document's text, in descending
    order of ids, and against the next document's own: (id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_within), the last being how many other different
    fingerprints lie within the radius.

    One shuffle sorts the documents into ranges. A task walks through its range and needs the next
    document only; the last of a range and the first of the next one are written out with their
    texts, one of each for a range, and joined.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.substring("text", 1, _HEAD).asc(), F.xxhash64("text").asc()]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = docs.schema[0].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(doc, text: str, following: str, fp: bytes, next_fp: bytes) -> tuple:
        new = edited(text, following)
        other = fp if new == text else fingerprint(new)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), digest, fp.hex(), other.hex(), likeness(fp, other), likeness(fp, next_fp)

    def batch(rows: list[tuple], id_type: pa.DataType, texts: list | None = None) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*names, "edge", "part", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_type = TaskContext.get().partitionId(), None, None
        for b in batches:
            id_type, rows = b.schema[0].type, []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fp = fingerprint(text)
                if held is None:
                    rows.append((doc, *[None] * 6, "first", part, text))
                else:
                    rows.append((*row(*held[:2], text, held[2], fp), None, None, None))
                held = (doc, text, fp)
            if rows:
                yield batch(rows, id_type)
        if held is not None:
            yield batch([(held[0], *[None] * 6, "last", part, held[1])], id_type)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    walked = stage(ranged.mapInArrow(walk, f"{schema}, edge string, part long, text string"), "edits")
    parts = walked.filter("edge = 'first'").select("part")
    after = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    after = after.select("part", F.coalesce("after", "least").alias("after"))
    firsts = walked.filter("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    ends = walked.filter("edge = 'last'").select("id", "text", "part").join(after, "part").join(firsts, "after").select("id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                row(doc, text, following, fingerprint(text), fingerprint(following))
                for doc, text, following in zip(*[c.to_pylist() for c in b.columns], strict=True)
            ]
            if rows:
                types = [b.schema[0].type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    done = walked.filter("edge IS NULL").select(*names).union(stage(ends.mapInArrow(finish, schema), "ends"))
    halves = [F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long") for at in (1, 17)]
    prints = done.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("times")).select("fingerprint", "times", halves[0].alias("hi"), halves[1].alias("lo"))
    prints = stage(prints, "prints")
    counted = prints.join(count_within(prints, radius), ["hi", "lo"], "left").select("fingerprint", "times", F.coalesce("n_within", F.lit(0).cast("long")).alias("n_within"))
    counted = stage(counted, "within")
    return join_hot(done, counted, ["fingerprint"], "times", done.count()).select(F.col("id").alias(id_col), *names[1:], "n_within")


def blocks(radius: int, extra: int = 2) -> list[tuple[tuple[int, int], ...]]:
    """The tables' keys: bit ranges (first, width) of every choice of `extra` blocks out of radius + extra."""
    n = radius + extra
    cuts = [BITS * i // n for i in range(n + 1)]
    return [tuple((cuts[i], cuts[i + 1] - cuts[i]) for i in chosen) for chosen in itertools.combinations(range(n), extra)]


def within_radius(prints: DataFrame, radius: int, id_col: str = "doc_id", queries: DataFrame | None = None) -> DataFrame:
    """(fingerprint, neighbour, bits): for every different fingerprint of the queries (all by default)
    all different fingerprints of `prints` within the radius, itself excepted.

    Two fingerprints that differ in at most `radius` bits agree on at least `extra` of radius + extra
    blocks, and so meet in the table of that choice. Each table is an equality join on the permuted
    block's bits; a pair is taken from the first table in which it meets.
    """
    tables = blocks(radius)
    digits = "0" * BITS

    def bits(fp: Column) -> Column:
        text = F.hex(fp)
        return F.concat(*[F.lpad(F.conv(F.substring(text, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        own = df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), bits(F.col("fingerprint")).alias("_b"))
        keys = [F.concat(F.lit(f"{k}:"), *[F.substring("_b", at + 1, w) for at, w in t]) for k, t in enumerate(tables)]
        return own.select(name, F.explode(F.array(*keys)).alias("key"))

    right = keyed(prints, "neighbour")
    left = keyed(queries if queries is not None else prints, "fingerprint")
    apart = sum(
        F.bit_count(F.conv(F.substring(F.hex("fingerprint"), 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.hex("neighbour"), 1 + 8 * i, 8), 16, 10).cast("long")))
        for i in range(len(digits) // 32)
    )
    met = left.join(right, "key").filter("fingerprint <> neighbour").select("fingerprint", "neighbour", apart.cast("int").alias("bits"))
    return met.filter(F.col("bits") <= radius).distinct()


def _masks(radius: int) -> list[tuple[int, int]]:
    """Each table's bits as masks of the two halves of a fingerprint."""
    out = []
    for table in blocks(radius):
        mask = sum(((1 << width) - 1) << (BITS - first - width) for first, width in table)
        out.append((mask >> 64, mask & ((1 << 64) - 1)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def count_within(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(hi, lo, n_within) of the different fingerprints (hi long, lo long) that have others within the radius.

    Only cells of the tables in which several fingerprints meet are looked at. Large ones are cut into
    blocks of which each two are compared by themselves, so a task holds two blocks however many near
    copies there are. A pair counts in the first table in which it meets.
    """
    masks = _masks(radius)
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), F.xxhash64(F.col("hi").bitwiseAND(F.lit(_signed(h))), F.col("lo").bitwiseAND(F.lit(_signed(m)))).alias("key"))
        for t, (h, m) in enumerate(masks)
    ])
    keyed = prints.select("hi", "lo", F.explode(keys).alias("k")).select("k.t", "k.key", "hi", "lo")
    shared = stage(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cells")
    met = keyed.join(broadcast_if_small(shared, shared.count()), ["t", "key"])
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("lo", "hi"), F.col("parts")).cast("int")
    cut = met.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cells = cut.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "hi", "lo")
    hs, ms = (np.array([m[k] for m in masks], np.uint64) for k in (0, 1))

    def compare(t: int, side: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        n = np.zeros(len(hi), np.int64)
        i, j = (np.arange(len(hi)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for at in range(0, len(i), 256):
            k = i[at : at + 256]
            x, y = hi[k, None] ^ hi[None, j], lo[k, None] ^ lo[None, j]
            p, q = np.nonzero(np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= radius)
            p, q, x, y = k[p], j[q], x[p, q], y[p, q]
            before = np.zeros(len(p), bool)
            for h, m in zip(hs[:t], ms[:t], strict=True):
                before |= ((x & h) | (y & m)) == 0
            fresh = ~before & (p != q)
            np.add.at(n, p[fresh], 1)
            if side[0] >= 0:
                np.add.at(n, q[fresh], 1)
        return n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            hi, lo = (np.ascontiguousarray(rows[:, k]).view(np.uint64) for k in (5, 6))
            n = np.zeros(len(rows), np.int64)
            for s, e in zip([0, *cut], [*cut, len(rows)], strict=True):
                if e > s + 1:
                    n[s:e] = compare(int(rows[s, 0]), rows[s:e, 4], hi[s:e], lo[s:e])
            return pa.RecordBatch.from_arrays([pa.array(c[n > 0]) for c in (rows[:, 5], rows[:, 6], n)], names=["hi", "lo", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
            rows = np.concatenate([*held, new])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if whole:
                yield out(rows[:whole])
            held = [rows[whole:]]
        if held:
            yield out(held[0])

    sorted_ = cells.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    found = sorted_.mapInArrow(each, "hi long, lo long, n long")
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n_within"))
