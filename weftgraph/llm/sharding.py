"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm").

The law is `key`: a row's shard follows from its key and the number of shards alone, without a
ring table, and one more shard takes rows only into itself.

Defined results. Sizes are UTF-8 bytes of the text plus 1, so null and empty texts have size 1,
and their CRC is that of no bytes. A null key is a key of its own. Repeated rows and equal texts
are placed by their keys like others; rows with one key share a shard. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, stage

SHARDS = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys: each key jumps ahead to the next count of shards at which it
    would move, until that lies beyond the given count."""
    key = keys.astype(np.uint64)
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.flatnonzero(j < shards)
    while len(live):
        b[live] = j[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[j[live] < shards]
    return b.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of any key column; a key counts as it is written, so its type does not matter."""

    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards))

    return place(F.xxhash64(key.cast("string")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot, grown_shard); slot numbers a shard's rows from 0 without
    gaps, grown_shard is the shard with one more.

    The rows are written once, in the order of shards within each input partition; slots follow
    from counts for each partition and shard, so that no shard is ever gathered in one task.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`")
    rows = docs.select(
        key.alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"),
    )
    rows = rows.sortWithinPartitions("shard").withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows, "shards").withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = stage(ranges.drop("_n"), "shardranges")
    slot = F.col("_before") + F.col("_at") - F.col("_first")
    return rows.join(broadcast_if_small(ranges, ranges.count()), ["_part", "shard"]).select(
        id_col, "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "grown_shard"
    )
