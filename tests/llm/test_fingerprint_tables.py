"""Counts from block tables against all pairs, and the order of repeated ids over many partitions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import fingerprints
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def within(prints, radius):
    own = sorted(set(prints))
    return {a: sum(a != b and (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= radius for b in own) for a in own}


@pytest.mark.parametrize("block", [2048, 7])
def test_counts_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (30, 128))
    bits = np.concatenate([base] + [base ^ (rng.random(base.shape) < p) for p in (0.005, 0.01, 0.02)] + [base[:1] ^ (rng.random((60, 128)) < 0.008)]).astype(np.uint8)
    prints = {np.packbits(b).tobytes() for b in bits}
    rows = [tuple(int.from_bytes(p[k : k + 8], "big", signed=True) for k in (0, 8)) for p in prints]
    df = spark.createDataFrame(rows, "hi long, lo long")
    found = {r.hi.to_bytes(8, "big", signed=True) + r.lo.to_bytes(8, "big", signed=True): r.n_within for r in fingerprints.count_within(df, 3, block).collect()}
    assert found == {k: n for k, n in within(prints, 3).items() if n} and max(found.values()) > 20
    assert fingerprints.count_within(df.limit(0)).count() == 0


def test_query_counts(spark):
    found = QUERIES["op10_fingerprints"](spark, SF).collect()
    expected = within([bytes.fromhex(r.fingerprint) for r in found], fingerprints.RADIUS)
    assert all(r.n_within == expected[bytes.fromhex(r.fingerprint)] for r in found)


def test_repeated_ids_over_many_partitions(spark):
    r = random.Random(2)
    rows = [(i % 4, "".join(r.choice("abc ") for _ in range(9)) + str(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = fingerprints.edits(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    expected = []
    for k, (doc, text) in enumerate(order):
        n = len(text) // 3
        expected.append((doc, hashlib.sha256((text[: len(text) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()))
    assert sorted((x.doc_id, x.edited_sha256) for x in found) == sorted(expected)


def test_nulls_and_empty_tables(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "a"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("times", F.lit(1))
    found = fingerprints.edits(df).collect()
    assert len(found) == 5 and {x.n_within for x in found} == {0}
    empty = fingerprints.with_fingerprints(df.limit(0))
    assert fingerprints.within_radius(empty, 2).count() == 0 and fingerprints.edits(df.limit(0)).count() == 0
    nulls = fingerprints.with_fingerprints(df)
    assert sorted(bytes(x.fingerprint) == bytes(16) for x in nulls.collect()) == [False, True, True, True, True]
    assert fingerprints.within_radius(nulls, 2).count() == 0
