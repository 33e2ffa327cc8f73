"""Row numbers inside groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.staging import stage

BROADCAST_ROWS = 200_000


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "n") -> DataFrame:
    """Adds the 1-based number of each row inside its group, in the given order.

    The rows are sorted into ranges by group and order, so a hot group spans many of them, and written
    with their places; numbers follow from the counts of each range and group, a table of about as
    many rows as there are ranges and groups.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows, "numbered").withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("_part", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnRenamed("_part", "_range")
    ranges = stage(ranges, "ranges")
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    joined = rows.join(small, (F.col("_part") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name)
