"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may go without it (tests); it
    then gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    path = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _folder(spark: SparkSession) -> str:
    """The application's own folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/weftgraph-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before; the folder then stays
        return


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deals the rows over all cores by a hash of columns whose values rarely repeat, for work that is long for
    each row: a table of few bytes is read by few tasks. Equal rows meet, so repeats stay deterministic."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


BROADCAST_ROWS = 200_000


def counted(df: DataFrame, tag: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of slim rows, hinted for a broadcast if it has few of them by count; else its joins shuffle."""
    table = stage(df, tag)
    few = table.count() <= bound
    out = F.broadcast(table) if few else table
    out._staged, out._few = table._staged, few
    return out


def as_few(df: DataFrame, as_: DataFrame) -> DataFrame:
    """Hints a broadcast of df, which has no more rows than a counted table, if that one is small."""
    return F.broadcast(df) if as_._few else df


def exists(table: DataFrame) -> bool:
    """Whether a staged table's folder is still there."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._staged)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and the
    table survives the loss of executors. The write's shuffle files are given up when it is done."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Removes staged tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_staged", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
