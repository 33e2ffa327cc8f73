"""A session with the settings the library's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """UTC time, adaptive execution with skew handling; everything else as the cluster sets it."""
    builder = SparkSession.builder.appName("weftgraph")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
