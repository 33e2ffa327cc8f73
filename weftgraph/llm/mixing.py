"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A document's expected copies are its source's target divided by its source's size. Within a source
the documents lie in order of size; the running sum of expected copies, moved by one random offset
for each source, crosses an integer boundary once for every copy that is emitted. As a source's
documents all expect the same number of copies, the running sum is that number times the rank, and
as ranks follow size, the words taken differ from the target by about one document's at most.

Defined results. Null and empty texts have size 0 and are sampled like others. A null source is a
source, ordered last. Repeated rows are sampled as rows of their own; rows alike in source, size,
id and text are interchangeable. Sources without words have target 0 and no copies. An empty table
gives an empty result. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, stage

WEIGHTS = (5, 2, 1)  # by the rank of the source, repeating
CAP = 3  # most copies of a document, and so most of a target in units of its source's size
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, size) -> with weight and target.

    Targets share all sizes by weight but stop at cap times the source's size, and the excess is
    shared again until none is above: the sources that stop are those with the smallest ratio of
    cap to weight. In that order, source k stops if its cap is at most its share of what the
    sources before it leave. The division is the only operation on doubles.
    """
    ranked = sources.withColumn(
        "weight",
        F.element_at(
            F.array(*map(F.lit, weights)),
            ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
        ).cast("long"),
    )
    top = F.col("size") * cap
    order = Window.orderBy((top.cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = ranked.select(
        "*",
        (F.sum("size").over(everything) - F.coalesce(F.sum(top).over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_among"),
    ).withColumn("_stops", top * F.col("_among") <= F.col("weight") * F.col("_left"))
    free = F.when(~F.col("_stops"), F.col("_left"))
    among = F.when(~F.col("_stops"), F.col("_among"))
    return left.select(
        "source", "size", "weight",
        F.when(F.col("_stops"), top.cast("double"))
        .otherwise((F.col("weight") * F.max(free).over(everything)).cast("double") / F.max(among).over(everything))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """For each row: row (a struct of the kept columns, all by default), source, size, source_size,
    target, copies and taken (words).

    One shuffle orders the rows by source, size and id into ranges, which splits a hot source over
    many partitions. The ranges are written with each row's place; ranks follow from counts for
    each range and source, a table of about as many rows as there are ranges and sources.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(text).alias("size"),
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(text).alias("_hash"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("_id").asc_nulls_first(), F.col("_hash").asc()]
    if keep:  # without texts it costs less to write the rows than to count words again where ranges are sampled
        rows = stage(rows, "mixslim")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stage(rows.drop("_id", "_hash").withColumn("_at", place), "mix")
    part = F.shiftright("_at", 33).alias("_part")
    ranges = rows.groupBy(part, "source").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"), F.min("_at").alias("_first")
    )
    ranges = stage(ranges, "mixranges")
    sources = targets(ranges.groupBy("source").agg(F.sum("_size").alias("size")), weights, cap)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.join(sources, ranges.source.eqNullSafe(sources.source)).select(
        F.col("_part"), ranges.source.alias("_source"), "_before", "_first", F.col("size").alias("source_size"), "target"
    )
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null"))))
    ranges = ranges.withColumn("_offset", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0)
    ranges = stage(ranges, "mixranges")
    joined = rows.withColumn("_part", part).alias("r").join(
        broadcast_if_small(ranges, ranges.count()).alias("g"),
        (F.col("r._part") == F.col("g._part")) & F.col("r.source").eqNullSafe(F.col("g._source")),
    )
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * each + F.col("_offset")) - F.floor(rank * each + F.col("_offset"))
    return joined.select(
        "row", F.col("r.source").alias("source"), "size", "source_size", "target", crossed.cast("long").alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
