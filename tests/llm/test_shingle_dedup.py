"""The pipeline's near-dedup stage: five-word shingles, similarity of 0.8 or more."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import components
from weftgraph.llm import shingle_dedup


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_stage_drops_all_near_copies_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: plain(r.text) for r in docs.collect()}
    ids = sorted(sets)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if alike(sets[ids[i]], sets[ids[j]])]
    assert sum(sets[ids[i]] != sets[ids[j]] for i, j in pairs) >= 5  # near copies, not only equal texts
    expected = components(len(ids), pairs)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [ids[i] for i in range(len(ids)) if expected[i] == i]


def test_pairs_at_the_edge_of_the_similarity(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for n in (4, 5, 12, 40, 200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changed in range(0, n // 6 + 2):
            new = words[: n - changed] + [f"x{rng.randrange(10**6)}" for _ in range(changed)]
            texts.append(" ".join(new))
    texts += [" ".join(["same passage in very many texts here"] * 3 + [f"y{rng.randrange(10**6)}" for _ in range(10)]) for _ in range(60)]
    sets = [plain(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sample in (shingle_dedup.SAMPLE, 20):  # the order of shingles must not decide about the result
        monkeypatch.setattr(shingle_dedup, "SAMPLE", sample)
        found = {r.doc_id: r.component for r in shingle_dedup.near_duplicates(df).collect()}
        assert [found[i] for i in range(len(texts))] == components(len(texts), pairs)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, common in [(1, 1, 1), (3, 40, 2), (100, 120, 90), (1000, 1300, 900), (5, 3000, 5), (0, 0, 0), (0, 9, 0)]:
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m) + 2, dtype=np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        assert shingle_dedup.least_apart(shingle_dedup.parities(a), shingle_dedup.parities(b)) <= len(np.setxor1d(a, b))
        assert shingle_dedup.least_apart(shingle_dedup.parities(a), shingle_dedup.parities(a)) == 0
    a, b = pool[:9], pool[9:18]
    assert shingle_dedup.least_apart(shingle_dedup.parities(a), shingle_dedup.parities(b)) >= 9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "word " * 40_000 + "end"), (None, "one two")]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1))
    kept = shingle_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert shingle_dedup.keep_one(df.limit(0)).count() == 0
    twice = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (2, "e f g h"), (3, "e f g h"), (None, "i j k"), (None, "l m n")]
    kept = shingle_dedup.keep_one(spark.createDataFrame(twice, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "i j k"), (0, "l m n"), (1, "a b c d"), (2, "e f g h")]


def test_trees_link_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(8)
    flips = (rng.random((400, 64)) < 0.05) * rng.integers(0, 2, (400, 64))
    prints = np.packbits(flips.astype(np.uint8), axis=1).view(np.int64).ravel()  # some of them stand for several sets
    pairs = [(i, j) for i in range(400) for j in range(i) if ((int(prints[i]) ^ int(prints[j])) & (2**64 - 1)).bit_count() <= 3]
    sets = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints)], "fp long, simhash long")
    found = shingle_dedup.by_trees(sets).collect()
    assert len(set(prints.tolist())) < 400 and all(r.fp != r.other for r in found)
    assert components(400, [(r.fp, r.other) for r in found]) == components(400, pairs)


def test_fingerprint_of_a_set():
    own = shingle_dedup.shingles("one two three four five six seven eight nine")
    assert len(own) == 5 and shingle_dedup.simhash(own[:0]) == 0
    assert shingle_dedup.simhash(own) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > 5)


def test_stage_goes_through_the_trees_first(spark, monkeypatch):
    """Pairs that the trees link are compared; without the trees the exact join alone gives the same rows."""
    words = [f"w{k}" for k in range(600)]
    near = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (200, 400)]  # 10 of 601 shingles
    prints = [shingle_dedup.simhash(shingle_dedup.shingles(t)) for t in (" ".join(words), *near)]
    assert min((prints[0] ^ p).bit_count() for p in prints[1:]) <= shingle_dedup.RADIUS
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near[0]), (3, near[1]), (4, "a b c")], "doc_id long, text string")
    seen, alike = [], shingle_dedup.alike
    monkeypatch.setattr(shingle_dedup, "alike", lambda pairs, *a: seen.append(pairs.count()) or alike(pairs, *a))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [1, 4] and seen[0] > 0  # the first pairs to be compared are those of the trees
    monkeypatch.setattr(shingle_dedup, "by_trees", lambda sets: spark.createDataFrame([], "fp long, other long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == kept
