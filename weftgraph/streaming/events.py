"""Streaming twins of the runtime operators. Each is a plan over a streaming DataFrame; `run_available`
drives a plan over what a file source holds and returns its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.staging import shared_dir


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a Parquet table, with the table's own schema. A stream's source is a folder, so
    a table of one file is read as that file of its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def throughput(events: DataFrame, window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", name: str = "event_type") -> DataFrame:
    """(start, name, n): events of each window, late ones included up to the watermark. State is one
    counter for each open window and name."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window_of = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stamped.groupBy(window_of.alias("w"), name).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), name, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(start, end, key, n): runs of a key's events with no gap longer than the given one."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = stamped.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def subscribe(events: DataFrame, types: list[str], column: str = "event_type") -> DataFrame:
    """The events of some types, as they come."""
    return events.filter(F.col(column).isin(*types))


def deduplicated(events: DataFrame, key: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """The first of each key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def alerts(events: DataFrame, is_error: Column, window: str = "5 minutes", least: float = 0.5, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, rate): windows whose error rate reaches a bound."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rates = stamped.groupBy(F.window(ts, window).alias("w")).agg((F.sum(is_error.cast("long")) / F.count(F.lit(1))).alias("rate"))
    return rates.filter(F.col("rate") >= least).select(F.col("w.start").alias("start"), "rate")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now. Batches are written to a folder of their own,
    so one that runs again replaces itself; the last batch is the result of a complete stream, all
    batches are that of an appending one."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    started = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch").select(*stream.columns)


def upsert_into(stream: DataFrame, store_root: str, key: list[str], order: str) -> DataFrame:
    """Keeps the last row of each key: each micro-batch is reduced to one row a key and merged with the
    table so far into a new version; a batch that runs again writes its version again."""
    from weftgraph.operators.store import last_per_key

    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        fresh = last_per_key(batch, key, order)
        if number:
            old = spark.read.parquet(f"{store_root}/v={number - 1}")
            fresh = last_per_key(old.unionByName(fresh), key, order)
        fresh.write.mode("overwrite").parquet(f"{store_root}/v={number}")

    started = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{store_root}-checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    versions = spark.read.parquet(store_root)
    return versions.filter(F.col("v") == versions.agg(F.max("v")).first()[0]).drop("v")
