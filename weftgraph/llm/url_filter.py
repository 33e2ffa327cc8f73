"""URL filters by a sort-merge range join, with DataFrame functions only.

A host becomes the canonical key of its labels in reverse, each followed by a dot: a rule's host and
all its subdomains are the keys that start with the rule's key, which is an interval. Intervals are
nested or disjoint. Rules and urls are sorted together; wherever an interval begins or ends, an event
carries the stack of the rules that are active from there on, and the sweep hands each url the stack
of the last event at or before its key. Of the stack's rules whose path starts the url's path, the
longest wins.

Defined results. A null url and one without `://` have an empty host and path; no rule fits, and the
default verdict holds. Repeated rows and urls are judged alike. Of two rules with the same host and
path the one that blocks wins. An empty table gives an empty result, an empty rule set the default
for all. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, stage

DEFAULT = "allow"
#: host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_STACK = "array<struct<host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.instr(rest, "/") > 0, rest.substr(F.instr(rest, "/"), F.length(rest))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def events(rules: DataFrame) -> DataFrame:
    """(key, stack): from this key on, up to the next event's, the stack's rules are active.

    The stack of a rule's host holds its own rules and those of all hosts that it lies under, found
    by an equality join on the host's suffixes. An interval's end is its key with the last dot
    replaced by the next character; there the stack of the nearest host above holds again.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is above allow
    own = rules.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split(F.col("key"), r"\.", -1)
    parts = F.size(labels) - 1
    up = own.select("key", F.explode(F.sequence(F.lit(1), parts)).alias("_n"), labels.alias("_l"), parts.alias("_parts"))
    up = up.select("key", (F.col("_n") == F.col("_parts")).alias("_self"), F.concat(F.array_join(F.slice("_l", F.lit(1), F.col("_n")), "."), F.lit(".")).alias("_up"))
    above = up.join(own.select(F.col("key").alias("_up"), "own"), "_up").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(~F.col("_self"), F.col("own")))).alias("_outer")
    )
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return above.select("key", F.col("stack").cast(_STACK)).union(above.select(end, F.col("_outer").cast(_STACK)))


def judge(urls: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row.

    One shuffle sorts urls and events into ranges; ties are dealt out by the row's place, so a very
    common host spans many ranges. What a range inherits is the last event before it, from a table
    of one row for each range with an event.
    """
    rules = rules if rules is not None else rule_table(urls.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("tie"), "*", F.lit(None).cast(_STACK).alias("stack"))
    marks = events(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[3:6]], "stack")
    swept = rows.unionByName(marks).repartitionByRange("key", "kind", "tie").sortWithinPartitions("key", "kind", "tie")
    swept = stage(swept.drop("key", "tie").withColumn("at", F.monotonically_increasing_id()), "urls")
    part = F.shiftright("at", 33).alias("part")
    last = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = swept.select("*", part).withColumn("held", F.last(F.when(F.col("kind") == 0, F.struct("stack")), ignorenulls=True).over(last))
    ranges = swept.groupBy(part).agg(F.max_by(F.struct("stack"), F.when(F.col("kind") == 0, F.col("at"))).alias("final"))
    ranges = ranges.select("part", F.last("final", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    ranges = stage(ranges, "ranges")
    held = held.filter("kind = 1").join(broadcast_if_small(ranges, ranges.count()), "part", "left")
    stack = F.coalesce(F.col("held.stack"), F.col("carried.stack"))
    fits = F.filter(stack, lambda r: F.col("path").startswith(r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(F.concat(r["host"], r["path"])).alias("n"), F.length(r["host"]).alias("m"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return held.select("id", "host", "path", longest.alias("won")).select(
        F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )
