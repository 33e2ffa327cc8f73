"""Sinks: JSON and JSON lines with sorted keys, replay arrays, and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_json(df: DataFrame) -> Column:
    """A row as JSON with its keys in order; nulls are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(to_json(df).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, as many files as the rows have partitions."""
    json_lines(df).write.mode("overwrite").text(path)


def replay_array(journal: DataFrame, order: str = "sequence") -> DataFrame:
    """(value): the lines of a JSON array over a sorted journal: each element is a row, so the array is
    written by many tasks and is valid when its parts are read in order."""
    ordered = journal.withColumn("_json", to_json(journal))
    ends = ordered.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ordered = ordered.crossJoin(F.broadcast(ends)).orderBy(order)
    return ordered.select(F.concat(F.when(F.col(order) == F.col("_lo"), "[").otherwise(""), F.col("_json"), F.when(F.col(order) == F.col("_hi"), "]").otherwise(",")).alias("value"))


def write_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a numbered version of a table; readers take the last finished one by ``read_table``, so they see
    the old table or the new one and never none. Older versions but `keep` are removed."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    old = _versions(fs, at, path)
    fresh = f"{path.rstrip('/')}/v{(old[-1][0] if old else 0) + 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    for _, version in old[: max(0, len(old) + 1 - keep)]:
        fs.delete(at(version), True)
    return fresh


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished version of a table; none if there is none."""
    fs, at = _files(spark, path)
    found = _versions(fs, at, path)
    return spark.read.parquet(found[-1][1]) if found else None


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(fs, at, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the finished versions, which hold a mark of their writer's success."""
    marks = fs.globStatus(at(f"{path.rstrip('/')}/v*/_SUCCESS")) or []
    folders = [m.getPath().getParent() for m in marks]
    return sorted((int(f.getName()[1:13]), f.toString()) for f in folders)


def write_checkpoint(files: DataFrame, path: str) -> str:
    """Keeps what a later scan compares with: path, size, time and hash of each file."""
    return write_table(files.select("path", "size_bytes", "modified_at", "hash_value"), path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The last checkpoint, without rows if there is none or it can't be read."""
    found = read_table(spark, path)
    return spark.createDataFrame([], "path string, size_bytes long, modified_at timestamp, hash_value string") if found is None else found
