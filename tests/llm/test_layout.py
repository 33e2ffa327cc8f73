"""Sharding, packing and mixing."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import mixing, packing, sharding
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = [(1, None, "b"), (2, "", None), (3, "one two", "b"), (3, "one two", "b"), (4, "wörter hier " * 30_000, "a"), (None, "x", "a"), (5, "a\x0bb c d", None)]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("size", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("_at", F.lit(0)).withColumn("shard", F.lit(9)).withColumn("ids", F.lit(1))


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys[:500]] + sharding.jump(keys[500:], n).tolist()
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new]) == {8} and abs((old != new).mean() - 1 / 9) < 0.02


def test_shards(spark):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), frame(spark)):
        found = sharding.assign(df).collect()
        assert len(found) == df.count()
        for s in range(8):
            slots = sorted(r.slot for r in found if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, 8) for r in found)
    sizes = sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found)
    assert sizes == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in ROWS)
    assert sharding.assign(frame(spark).limit(0)).count() == 0


def test_ids_are_the_tokenizers_own():
    """Of texts over many scripts, and of another kind of file, which runs in tokenizers itself."""
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.ranked and len(next(other(["one two"]))) == 8
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    plain.encode_special_tokens = True
    texts = ["", " ", "  a  b\n\n c\t\td ", "it's we'll 'tis", "<|endoftext|> x<|endoftext|>", "Ünï cödé 東京 123४५६ 1a2b", "a b  　c\x85d\x1ce", "é \U0001f600\U0001f468‍\U0001f469"]
    texts += ["".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in [*range(0, 0x3400, 512), 0xA600, 0xAC00, 0xF900, 0xFE00, 0x10400, 0x1F600]]
    assert own.ranked
    for text, ids in zip(texts, own(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 400)
    which, offset, n = packing.best_fit_decreasing(lengths, 100)
    rooms = []  # plain best fit
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - lengths[i])
    assert n == len(rooms)
    for w in range(n):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(which == w))
        assert [a for a, _ in own] == np.cumsum([0] + [b for _, b in own])[:-1].tolist() and sum(b for _, b in own) <= 100
    assert sorted(rooms) == sorted(100 - np.bincount(which, lengths, n).astype(int))


def check_packed(pieces, texts, window=1024):
    """texts: of each row. Every token lies in one piece, and sequences have no gaps."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    expected = sorted(plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts)
    starts, docs = {}, []
    for p in pieces:
        starts.setdefault((p.doc_id, p.start, p.doc_tokens), []).append(np.frombuffer(p.ids, "<u4").tolist())
    for (doc, start, total), found in starts.items():
        if start == 0:
            for k in range(len(found)):
                ids, at = [], 0
                while at < total:
                    piece = sorted(starts[doc, at, total])[k]
                    ids, at = ids + piece, at + len(piece)
                docs.append(ids)
    assert sorted(docs) == expected
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0] + [b for _, b in s])[:-1].tolist() and sum(b for _, b in s) <= window
    return sum(b for s in sequences.values() for _, b in s) / (window * len(sequences))


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packed(packing.pack(docs).collect(), [r.text for r in docs.collect()]) > 0.97
    check_packed(packing.pack(frame(spark).repartition(2)).collect(), [t for _, t, _ in ROWS])
    assert packing.pack(frame(spark).limit(0)).count() == 0
    found = QUERIES["op4_packing"](spark, SF).collect()
    pieces = {(p.doc_id, p.start): p for p in packing.pack(docs).collect()}
    assert all(r.ids_crc32 == zlib.crc32(pieces[r.doc_id, r.start].ids) for r in found)


def water(sizes, weights):
    """Targets by repeated sharing."""
    capped = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest, among = sum(sizes) - sum(capped.values()), sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * rest >= 3 * sizes[i] * among]
        if not over:
            return [capped.get(i, weights[i] * rest / among if among else 0) for i in range(len(sizes))]
        capped |= {i: 3 * sizes[i] for i in over}


def test_targets(spark):
    for sizes in ([10, 1000, 3, 0, 70], [5], [100, 1, 1, 1, 1, 1], [0, 0]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
        found = {r.source: r.target for r in mixing.targets(df).collect()}
        expected = water(sizes, [5, 2, 1, 5, 2, 1][: len(sizes)])
        assert np.allclose([found[f"s{i}"] for i in range(len(sizes))], expected)


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    found = mixed.collect()
    by = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = {r.row.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.row.doc_id: r.taken for r in found}
    assert mixing.emit(mixed).count() == sum(r.copies for r in found)


def test_edges_of_mixing(spark):
    df = frame(spark)
    found = mixing.mix(df).collect()
    assert len(found) == len(ROWS) and all(set(r.row.asDict()) == set(df.columns) for r in found)
    assert sorted((r.row.doc_id or 0, r.size) for r in found) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 60_000), (5, 3)]
    assert mixing.emit(mixing.mix(df)).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("size = 'clash' AND coalesce(text, '') = ''")).collect()} == {0}
