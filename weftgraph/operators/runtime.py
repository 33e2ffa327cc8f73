"""Events, journals, metrics, spans and health as batch plans; streaming twins are in `streaming`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.numbering import numbered
from weftgraph.plans.staging import counted

RING = 1000


def log_since(events: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """Events after a cursor; the new cursor is the largest order value returned."""
    return events.filter(F.col(order) > cursor)


def recent(events: DataFrame, n: int = RING, order: str = "event_id") -> DataFrame:
    """The last n events, latest first."""
    return events.orderBy(F.col(order).desc()).limit(n)


def filter_events(events: DataFrame, types: list[str], column: str = "event_type") -> DataFrame:
    return events.filter(F.col(column).isin(*types))


def load_journal(lines: DataFrame) -> DataFrame:
    """(event_type, payload, timestamp, sequence, skipped) of JSON lines (value): either field naming,
    ISO or numeric times, bad lines marked as skipped, blank lines left out."""
    lines = lines.filter(F.trim("value") != "")
    bad = ~F.trim("value").startswith("{") | F.expr("try_parse_json(value)").isNull()
    get = lambda k: F.get_json_object("value", f"$.{k}")
    raw = get("timestamp")
    iso = F.expr("try_to_timestamp(get_json_object(value, '$.timestamp'))")
    ts = F.coalesce(F.expr("try_cast(get_json_object(value, '$.timestamp') AS DOUBLE)"), F.unix_micros(iso) / 1e6, F.lit(0.0))
    return lines.select(
        F.coalesce(get("event_type"), get("type")).alias("event_type"), F.coalesce(get("payload"), get("data")).alias("payload"),
        F.when(raw.isNull(), 0.0).otherwise(ts).alias("timestamp"), F.coalesce(F.expr("try_cast(get_json_object(value, '$.sequence') AS BIGINT)"), F.lit(0)).alias("sequence"),
        F.coalesce(bad, F.lit(True)).alias("skipped"),
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, payload, timestamp, sequence) of a journal of JSON lines; a line that is none fails the read."""
    schema = "event_type string, payload string, timestamp double, sequence long"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_journal(journal: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """The fresh events (event_type, payload, ...) numbered on from the journal's last sequence. Numbers come
    from sorted ranges; the journal itself is only asked for its largest one."""
    last = journal.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("_last"))
    rows = numbered(fresh.withColumn("_all", F.lit(0)), "_all", [F.col(order).asc()], "_n")
    return rows.crossJoin(F.broadcast(last)).withColumn("sequence", F.col("_last") + F.col("_n")).drop("_n", "_last", "_all")


def flush(events: DataFrame) -> DataFrame:
    """The log without its events."""
    return events.limit(0)


def last_sequence(journal: DataFrame, order: str) -> DataFrame:
    """The last sequence in file order, 0 if empty."""
    return journal.agg(F.coalesce(F.max_by("sequence", order), F.lit(0)).alias("last_sequence"))


def replay_from(journal: DataFrame, sequence: int) -> DataFrame:
    return journal.filter(F.col("sequence") >= sequence)


def replay(journal: DataFrame, handler: Callable[[Row], None], sequence: int | None = None, order: str = "sequence") -> int:
    """Hands the events to a handler in order, from a sequence on if it is given; returns how many. They come
    to the driver one sorted partition at a time."""
    n = 0
    for row in (journal if sequence is None else replay_from(journal, sequence)).orderBy(order).toLocalIterator():
        handler(row)
        n += 1
    return n


def cursor_after(events: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """(cursor): where a reader goes on after ``log_since``."""
    return log_since(events, cursor, order).agg(F.greatest(F.coalesce(F.max(order), F.lit(cursor)), F.lit(cursor)).cast("long").alias("cursor"))


def counter_snapshots(events: DataFrame, name: str = "event_type", order: str = "event_id") -> DataFrame:
    """Each event with its counter's value after it. A counter may hold most of all events, so numbers
    come from sorted ranges and not from a window over the counter."""
    return numbered(events.select(order, name), name, [F.col(order).asc()], "value")


def ring(events: DataFrame, n: int = RING, name: str = "event_type", order: str = "event_id") -> DataFrame:
    """The last n samples of each name. Spark keeps n rows of a name in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.col(order).desc()))
    return events.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latency(events: DataFrame, q: float, value: str = "value", name: str = "event_type") -> DataFrame:
    """(name, value): the sample at 0-based place floor(q n) of the sorted ones, so 0.5 is the upper median.

    Samples are numbered over sorted ranges, so no name's samples are gathered, however many different
    values they have.
    """
    samples = events.filter(F.col(value).isNotNull()).select(name, F.col(value).alias("value"))
    total = samples.groupBy(name).agg(F.count(F.lit(1)).alias("_total"))
    placed = numbered(samples, name, [F.col("value").asc()], "_n")
    return placed.join(counted(total, "totals"), name).filter(F.col("_n") == F.floor(F.col("_total") * q) + 1).select(name, "value")


def throughput(events: DataFrame, now: Column, seconds: int = 60, name: str = "event_type", ts: str = "ts") -> DataFrame:
    """(name, rate): events of the last seconds, per second."""
    inside = events.filter(F.col(ts) > now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return inside.groupBy(name).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("rate"))


def error_rate(events: DataFrame, is_error: Column, by: str) -> DataFrame:
    """(by, rate): errors among all events."""
    return events.groupBy(by).agg((F.sum(is_error.cast("long")) / F.count(F.lit(1))).alias("rate"))


def prometheus(counters: DataFrame, prefix: str = "weftgraph_counter_") -> DataFrame:
    """(text): one line for each counter (name, value), in order of names. Counters are one row a name; for
    values with many labels see ``exposition``."""
    line = F.format_string(f"{prefix}%s %d", F.col("name"), F.col("value"))
    lines = counters.agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("l"))
    return lines.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def exposition(counters: DataFrame, gauges: DataFrame, errors: DataFrame, prefix: str = "weftgraph_") -> DataFrame:
    """(kind, name, line): a line for each counter, gauge and error count (name, value), to be written in the
    order of kinds and names; each line is a row, so many labels are many rows and no array."""
    every = None
    for k, (kind, rows) in enumerate((("counter", counters), ("gauge", gauges), ("error", errors))):
        own = rows.select(F.lit(k).alias("kind"), "name", F.concat(F.lit(f"{prefix}{kind}_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line"))
        every = own if every is None else every.unionByName(own)
    return every


def gauges(samples: DataFrame, name: str = "name", order: str = "event_id") -> DataFrame:
    """(name, value): the last value set of each gauge; a maximum, so combined before the shuffle."""
    return samples.groupBy(F.col(name).alias("name")).agg(F.max_by("value", order).alias("value"))


#: The phases of an index run, in order, and what it counts.
PHASES = ("discovery", "classification", "reading", "parsing", "semantic_tagging", "vault_integration", "index_output", "complete")
STATS = ("files_discovered", "files_classified", "files_read", "files_parsed", "files_tagged", "vault_nodes", "errors")


class Lifecycle:
    """The phase of a run and its counts."""

    def __init__(self) -> None:
        self.phase, self.stats = PHASES[0], dict.fromkeys(STATS, 0)

    def advance(self, phase: str | None = None) -> str:
        """To the next phase, or to the given one; the last one stays."""
        if phase is not None and phase not in PHASES:
            raise ValueError(f"unknown phase {phase}")
        self.phase = phase or PHASES[min(PHASES.index(self.phase) + 1, len(PHASES) - 1)]
        return self.phase

    def record(self, key: str, n: int = 1) -> None:
        """Unknown keys are not counted."""
        if key in self.stats:
            self.stats[key] += n


def span_durations(spans: DataFrame, now: Column) -> DataFrame:
    """Spans with duration_ms, their parent's name and the trace they inherit."""
    parent = spans.select(F.col("span_id").alias("_p"), F.col("name").alias("parent_name"), F.col("trace_id").alias("_t"))
    joined = spans.join(parent, F.col("parent_span_id") == F.col("_p"), "left")
    return joined.select("span_id", F.coalesce("trace_id", "_t", "span_id").alias("trace_id"), "parent_span_id", "name", "parent_name", ((F.coalesce("end_time", now) - F.col("start_time")) * 1000).alias("duration_ms"))


def span_tree(spans: DataFrame, deepest: int = 16) -> DataFrame:
    """(span_id, depth, root): by doubling of parent pointers, so depth d takes log2(d) joins."""
    up = spans.select("span_id", F.coalesce("parent_span_id", "span_id").alias("to"), F.when(F.col("parent_span_id").isNull(), 0).otherwise(1).alias("depth"))
    reached = 1
    while reached < deepest:
        far = up.select(F.col("span_id").alias("_s"), F.col("to").alias("_to"), F.col("depth").alias("_d"))
        up = up.join(far, F.col("to") == F.col("_s"), "left").select("span_id", F.coalesce("_to", "to").alias("to"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        reached *= 2
    return up.select("span_id", "depth", F.col("to").alias("root"))


def health(checks: DataFrame) -> DataFrame:
    """(status): the worst of the components (status, null for a check that crashed)."""
    rank = F.when(F.col("status") == "healthy", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    return checks.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r")).select(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), (F.col("r") + 1).cast("int")).alias("status"))
