"""The registered sharding query against the published algorithm from the key on, and ids of other types."""

import zlib

import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import embedding_dedup, sharding
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_query_from_the_key_on(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op3_sharding"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        key, raw = xxhash.xxh64_intdigest(str(r.doc_id), 42), (texts[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard, r.size, r.text_crc32, r.law) == (jump(key, 8), jump(key, 9), len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


def test_type_of_the_key_and_clashing_names(spark):
    rows = [(i, "x" * i) for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_at", F.lit(1))
    placed = [
        sorted((int(r.doc_id) if r.doc_id is not None else -1, r.shard) for r in sharding.assign(df.withColumn("doc_id", F.col("doc_id").cast(t))).collect())
        for t in ("long", "int", "string")
    ]
    assert placed[0] == placed[1] == placed[2]


def test_embeddings_with_string_ids(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0]), ("c", [0.0, 1.0]), (None, None), ("d", [1.0])]
    found = sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect())
    assert found == [("", 0, "", True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), ("c", 1, "c", True), ("d", 0, "d", True)]
