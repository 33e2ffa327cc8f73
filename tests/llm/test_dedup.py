import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import embedding_dedup, simhash_dedup
from weftgraph.llm.common import _rounds, connected_components, join_hot
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def components(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(300 + i, 301 + i) for i in range(60)] + [(400, 500 + i) for i in range(50)]
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    expected = components(600, pairs)
    assert {r.node: r.root for r in found} == {x: expected[x] for p in pairs if p[0] != p[1] for x in p}
    assert len(found) == len({r.node for r in found})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    in_rounds = _rounds(spark.createDataFrame([(max(p), min(p)) for p in pairs if p[0] != p[1]], "u long, v long").distinct(), -1).collect()
    assert sorted((r.node, r.root) for r in in_rounds) == sorted((r.node, r.root) for r in found)


def test_join_with_hot_keys(spark):
    keys = [k % 7 if k % 3 else 1 for k in range(30_000)] + list(range(100, 400)) + [None]
    rows = spark.createDataFrame(list(enumerate(keys)), "row long, key long")
    of = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("least"))
    found = {r.row: r.least for r in join_hot(rows, of, ["key"], "times", len(keys)).collect()}
    least = {}
    for row, key in enumerate(keys):
        least.setdefault(key, row)
    assert found == {row: least[key] for row, key in enumerate(keys) if key is not None}


def test_fingerprints_and_components_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    ids = sorted(docs)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 2]
    expected = components(len(ids), pairs)
    found = {r.doc_id: r for r in QUERIES["op6_simhash_dedup"](spark, SF).collect()}
    assert {k: r.fingerprint for k, r in found.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert [ids.index(found[k].component_id) for k in ids] == expected


@pytest.mark.parametrize("spread", [64, 7])
def test_tree_finds_all_pairs(spark, spread):
    """Random values, and a dense ball of near copies that must be cut into blocks."""
    rng = np.random.default_rng(spread)
    flips = (rng.random((1500, 64)) < spread / 128) * rng.integers(0, 2, (1500, 64))
    fps = np.unique(np.packbits(flips.astype(np.uint8), axis=1).view(np.uint64).ravel())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for cell, block in ((100, 150), (40, 30)):
        edges = simhash_dedup.links(df, len(fps), cell=cell, block=block).collect()
        at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
        assert components(len(fps), [(at[e.a], at[e.b]) for e in edges]) == components(len(fps), list(zip(i.tolist(), j.tolist())))


@pytest.mark.parametrize("spread, most, piece", [(64, 64, 100), (7, 64, 100), (7, 40, 10_000)])
def test_large_leaves_get_trees_of_their_own(spark, monkeypatch, spread, most, piece):
    """A small sample for the driver's tree leaves large leaves, which are split again on the executors."""
    rng = np.random.default_rng(spread)
    flips = (rng.random((1500, 64)) < spread / 128) * rng.integers(0, 2, (1500, 64))
    fps = np.unique(np.packbits(flips.astype(np.uint8), axis=1).view(np.uint64).ravel())
    df, rounds, plain = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), [], simhash_dedup._grown
    monkeypatch.setattr(simhash_dedup, "_grown", lambda rows, *a: rounds.append(rows.count()) or plain(rows, *a))
    edges = simhash_dedup.links(df, len(fps), cell=30, block=25, most=most, piece=piece).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    assert components(len(fps), [(at[e.a], at[e.b]) for e in edges]) == components(len(fps), list(zip(i.tolist(), j.tolist())))
    assert rounds and rounds[0] > 100


def test_edges_of_simhash(spark):
    long = "word " * 40_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, long), (6, long), (None, "one two"), (7, "É é"), (8, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    found = simhash_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    assert of[1].fp == of[2].fp == of[3].fp == 0 and of[3].component == 1
    assert of[5].component == of[4].component == of[None].component == 4
    assert of[7].fp != of[8].fp  # only A-Z are folded
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0
    twice = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (2, "e f g h"), (3, "e f g h"), (None, "i j k"), (None, "l m n")]
    kept = simhash_dedup.keep_one(spark.createDataFrame(twice, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "i j k"), (0, "l m n"), (1, "a b c d"), (2, "e f g h")]


def brute(vectors):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    pairs = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(v, float) / np.abs(v).max() for v in (vectors[i], vectors[j]))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    pairs.append((i, j))
    return pairs


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0, 0.05, 0.2, 0.28, 0.3, 0.35, 0.5, 1)] + rng.normal(size=(150, 16)).tolist()
    vectors += [vectors[0], [2 * x for x in vectors[0]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [1e-300] * 16, [1e300] * 16]
    pairs = brute(vectors)
    expected = components(len(vectors), pairs)
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rid string")
    for block in (4096, 20):
        found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert [found[i].n_links for i in range(len(vectors))] == [sum(i in p for p in pairs) for i in range(len(vectors))]
        assert [found[i].component_id for i in range(len(vectors))] == expected
        assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    found = {r.vec_id: r for r in QUERIES["op7_embedding_dedup"](spark, SF).collect()}
    expected = components(len(rows), list(zip(i.tolist(), j.tolist())))
    assert [found[r.vec_id].component_id for r in rows] == [rows[k].vec_id for k in expected]
    assert sum(r.n_links for r in found.values()) == 2 * len(i)
