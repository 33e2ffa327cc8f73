"""Registered queries over events as a log, journal, metrics and spans, over conversations as edits, and
the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import edits, runtime
from weftgraph.plans import fixtures as X
from weftgraph.plans.registry import query
from weftgraph.plans.staging import shared_dir
from weftgraph.sources import export
from weftgraph.streaming import events as stream


def events(spark, d):
    return X.table(spark, d, "events")


@query("r02_recent", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def _(spark, d):
    return runtime.recent(events(spark, d)).select("event_id", "event_type")


@query("r03_log_since", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def _(spark, d):
    return runtime.log_since(events(spark, d), 500).select("event_id", "event_type")


@query("r05_timeline", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50")
def _(spark, d):
    return runtime.recent(events(spark, d), 50).select("event_id", "event_type", "value")


def journal_lines(spark, d):
    """Events as journal lines in both namings, some broken, some blank."""
    e, i = events(spark, d), F.col("event_id")
    one = F.to_json(F.struct(F.col("event_type"), F.col("props").alias("payload"), F.lit("2024-01-01T00:00:10Z").alias("timestamp"), i.alias("sequence")))
    two = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("props").alias("data"), F.lit(12.5).alias("timestamp")))
    return e.select(F.when(i % 10 == 3, "{broken").when(i % 10 == 4, " ").when(i % 10 == 5, "[1]").when(i % 2 == 0, one).otherwise(two).alias("value"))


@query("r07_load_journal", "SELECT CASE WHEN event_id % 10 IN (3, 5) THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 10 IN (3, 5) THEN NULL ELSE props END AS payload, CASE WHEN event_id % 10 IN (3, 5) THEN 0.0::DOUBLE WHEN event_id % 2 = 0 THEN 1704067210.0::DOUBLE ELSE 12.5::DOUBLE END AS timestamp, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END::BIGINT AS sequence, event_id % 10 IN (3, 5) AS skipped FROM events WHERE event_id % 10 <> 4")
def _(spark, d):
    return runtime.load_journal(journal_lines(spark, d))


@query("r08_replay_from", "SELECT event_id AS sequence, event_type FROM events WHERE event_id >= 700")
def _(spark, d):
    return runtime.replay_from(events(spark, d).select(F.col("event_id").alias("sequence"), "event_type"), 700)


@query("r09_last_sequence", "SELECT coalesce(arg_max(event_id % 1000, event_id), 0)::BIGINT AS last_sequence FROM events")
def _(spark, d):
    return runtime.last_sequence(events(spark, d).select((F.col("event_id") % 1000).alias("sequence"), "event_id"), "event_id")


@query("r10_filter_events", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")
def _(spark, d):
    return runtime.filter_events(events(spark, d), ["error", "signup"]).select("event_id")


@query("k05_append_journal", "SELECT max(event_id) OVER () + row_number() OVER (ORDER BY r_regionkey) AS sequence, r_name AS event_type FROM region, (SELECT max(event_id) AS event_id FROM events)")
def _(spark, d):
    fresh = X.table(spark, d, "region").select(F.col("r_name").alias("event_type"), "r_regionkey")
    return runtime.append_journal(events(spark, d).select(F.col("event_id").alias("sequence")), fresh, "r_regionkey").select("sequence", "event_type")


@query("m01_counter_snapshots", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS value FROM events")
def _(spark, d):
    return runtime.counter_snapshots(events(spark, d))


@query("m02_p50", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(spark, d):
    return runtime.latency(events(spark, d), 0.5)


@query("m03_p99", "SELECT event_type, list_sort(list(value))[floor(count(*) * 0.99::DOUBLE)::BIGINT + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(spark, d):
    return runtime.latency(events(spark, d), 0.99)


@query("m04_ring", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 1000")
def _(spark, d):
    return runtime.ring(events(spark, d)).select("event_id", "event_type")


@query("m05_throughput", "SELECT event_type, count(*) / 36000.0::DOUBLE AS rate FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 36000 SECONDS GROUP BY event_type")
def _(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("ts").alias("_now"))
    return runtime.throughput(e.crossJoin(F.broadcast(now)), F.col("_now"), 36_000)


@query("m06_error_rate", "SELECT user_id, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY user_id")
def _(spark, d):
    return runtime.error_rate(events(spark, d), F.col("event_type") == "error", "user_id").select("user_id", F.round("rate", 6).alias("rate"))


_COUNTERS = "SELECT event_type AS name, count(*) AS value FROM events GROUP BY event_type"


def counters(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))


@query("m07_counters", _COUNTERS)
def _(spark, d):
    return counters(spark, d)


@query("k06_prometheus", f"SELECT string_agg('weftgraph_counter_' || name || ' ' || value, chr(10) ORDER BY name) AS text FROM ({_COUNTERS})")
def _(spark, d):
    return runtime.prometheus(counters(spark, d))


@query("k01_json", "SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def _(spark, d):
    return export.json_lines(X.table(spark, d, "nation"))


@query("k04_replay_array", "SELECT CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN '[' ELSE '' END || '{\"event_type\":\"' || event_type || '\",\"sequence\":' || event_id || '}' || CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN ']' ELSE ',' END AS value FROM events")
def _(spark, d):
    return export.replay_array(events(spark, d).select("event_type", F.col("event_id").alias("sequence")))


def spans(spark, d):
    """Events as spans of one binary tree; every eighth has not ended."""
    e, i = events(spark, d), F.col("event_id")
    return e.select(i.cast("string").alias("span_id"), F.when(i == 0, "trace-0").alias("trace_id"), F.when(i > 0, F.floor((i - 1) / 2).cast("string")).alias("parent_span_id"), F.col("event_type").alias("name"), i.cast("double").alias("start_time"), F.when(i % 8 != 0, i + F.col("value")).alias("end_time"))


@query("t01_span_durations", "SELECT e.event_id::VARCHAR AS span_id, p.event_type AS parent_name, round((CASE WHEN e.event_id % 8 <> 0 THEN e.event_id + e.value ELSE 1000000 END - e.event_id) * 1000, 3) AS duration_ms FROM events e LEFT JOIN events p ON e.event_id > 0 AND p.event_id = (e.event_id - 1) // 2")
def _(spark, d):
    return runtime.span_durations(spans(spark, d), F.lit(1_000_000.0)).select("span_id", "parent_name", F.round("duration_ms", 3).alias("duration_ms"))


@query("t01_span_tree", "WITH RECURSIVE t AS (SELECT event_id AS id, 0 AS depth FROM events WHERE event_id = 0 UNION ALL SELECT e.event_id, depth + 1 FROM t JOIN events e ON e.event_id > 0 AND (e.event_id - 1) // 2 = t.id) SELECT id::VARCHAR AS span_id, depth::INTEGER AS depth, '0' AS root FROM t")
def _(spark, d):
    return runtime.span_tree(spans(spark, d), 32)


@query("t03_health", "SELECT CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events")
def _(spark, d):
    kind = F.col("event_type")
    return runtime.health(events(spark, d).select(F.when(kind == "view", "healthy").when(kind == "click", "degraded").alias("status")))


# edits ----------------------------------------------------------------------------------------------

_TURNS = f"t AS (SELECT a.conv_id, a.turn, list_sort(list_distinct(regexp_extract_all(a.text, '{T.WORD}'))) AS before, list_sort(list_distinct(regexp_extract_all(b.text, '{T.WORD}'))) AS after FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), diff AS (SELECT conv_id, turn, list_filter(after, lambda w: NOT list_contains(before, w)) AS added, list_filter(before, lambda w: NOT list_contains(after, w)) AS removed, list_filter(before, lambda w: list_contains(after, w)) AS modified FROM t)"


def turns(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("after"))
    return c.join(following, ["conv_id", "turn"]).select("conv_id", "turn", edits.names_diff(F.col("w"), F.col("after")).alias("d"))


@query("x01_names_diff", f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(added, ' ') AS added, array_to_string(removed, ' ') AS removed, array_to_string(modified, ' ') AS modified FROM diff")
def _(spark, d):
    return turns(spark, d).select("conv_id", "turn", *[F.array_join(f"d.{c}", " ").alias(c) for c in ("added", "removed", "modified")])


@query("x02_score_risk", f"WITH {_TURNS}, s AS (SELECT conv_id, turn, least(100, 10 * len(removed) + 3 * len(modified) + 2 * (turn % 4) + len(added))::BIGINT AS score FROM diff) SELECT conv_id, turn, score, CASE WHEN score > 50 THEN 'high' WHEN score > 20 THEN 'medium' ELSE 'low' END AS level, round(greatest(0.1::DOUBLE, 1 - score / 100.0::DOUBLE), 2) AS confidence FROM s")
def _(spark, d):
    t = turns(spark, d).select("conv_id", "turn", edits.risk(F.size("d.added"), F.size("d.removed"), F.size("d.modified"), F.col("turn") % 4).alias("r"))
    return t.select("conv_id", "turn", "r.score", "r.level", "r.confidence")


@query("x03_apply_edit", "WITH w AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN split_part(text, ' ', 2) ELSE 'not in there at all' END AS old FROM conversations) SELECT conv_id, turn, CASE WHEN old = '' THEN 'NEW' WHEN strpos(text, old) > 0 THEN substr(text, 1, strpos(text, old) - 1) || 'NEW' || substr(text, strpos(text, old) + length(old)) ELSE text END AS result FROM w")
def _(spark, d):
    t = F.col("turn") % 3
    c = X.table(spark, d, "conversations").withColumn("old", F.when(t == 0, "").when(t == 1, F.split_part("text", F.lit(" "), F.lit(2))).otherwise("not in there at all"))
    return c.select("conv_id", "turn", edits.apply_edit(F.col("text"), F.col("old"), F.lit("NEW")).alias("result"))


@query("x04_parse_edits", "SELECT n_nationkey AS reply_id, CASE WHEN n_nationkey % 4 < 2 THEN 'src/' || n_name WHEN n_nationkey % 4 = 2 THEN '' END AS path, CASE WHEN n_nationkey % 4 < 2 THEN n_name ELSE NULL END AS new_text, CASE n_nationkey % 4 WHEN 2 THEN 'edit without path' WHEN 3 THEN 'no JSON in reply' END AS warning FROM nation")
def _(spark, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    one = lambda path, new: F.to_json(F.struct(F.array(F.struct(path.alias("path"), F.lit("old").alias("old_text"), new.alias("new_text"))).alias("edits")))
    good, bad = one(F.concat(F.lit("src/"), n), n), one(F.lit(""), F.lit(None).cast("string"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```\ndone"))).when(k % 4 == 1, F.concat(F.lit("I think "), good, F.lit(" is it"))).when(k % 4 == 2, bad).otherwise("nothing to do")
    return edits.parse_edits(X.table(spark, d, "nation").select(k.alias("reply_id"), text.alias("text"))).select("reply_id", "path", "new_text", "warning")


def proposed(spark, d):
    c, t = X.table(spark, d, "conversations"), F.col("turn") % 4
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    own = c.select(path.alias("path"), F.col("text").alias("content"))
    old = F.when(t == 1, F.split_part("text", F.lit(" "), F.lit(1))).when(t == 2, "not in there at all").when(t == 3, F.col("text")).otherwise("x")
    return c.select(path.alias("edit_id"), F.when(t == 0, F.concat(path, F.lit("-gone"))).otherwise(path).alias("path"), old.alias("old_text"), F.when(t == 3, F.col("text")).otherwise("NEW").alias("new_text")), own


_REVIEW = "r AS (SELECT conv_id || '/' || turn AS edit_id, turn % 4 AS t, CASE turn % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'applies' WHEN 2 THEN 'unanchored' ELSE 'no-op' END AS verdict FROM conversations)"


@query("x05_review", f"WITH {_REVIEW} SELECT edit_id, verdict FROM r")
def _(spark, d):
    return edits.review(*proposed(spark, d)).select("edit_id", "verdict")


@query("x05_overall", f"WITH {_TURNS}, s AS (SELECT least(100, 10 * len(removed) + 3 * len(modified) + len(added)) AS score, turn FROM diff) SELECT CASE WHEN max(score) > 50 THEN 'high' WHEN max(score) > 20 THEN 'medium' ELSE 'low' END AS risk, min(round(greatest(0.1::DOUBLE, 1 - score / 100.0::DOUBLE), 2)) AS confidence, sum(turn)::BIGINT AS downstream FROM s")
def _(spark, d):
    t = turns(spark, d).select(edits.risk(F.size("d.added"), F.size("d.removed"), F.size("d.modified"), F.lit(0)).alias("r"), F.col("turn").alias("downstream"))
    return edits.overall(t.select("r.level", "r.confidence", "downstream"))


@query("x06_fingerprints", "SELECT conv_id || '/' || turn AS edit_id, turn % 2 = 0 AS current FROM conversations")
def _(spark, d):
    c = X.table(spark, d, "conversations")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    known = F.when(F.col("turn") % 2 == 0, F.substring(F.sha2("text", 256), 1, 16)).otherwise("old")
    return edits.matches_fingerprint(c.select(path.alias("edit_id"), path.alias("path"), known.alias("fingerprint")), c.select(path.alias("path"), F.col("text").alias("content")))


# streaming twins ------------------------------------------------------------------------------------


@query("st_throughput", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    counted = stream.throughput(stream.read(spark, f"{d}/events.parquet"), "1 hour")
    return stream.run_available(counted, "complete").select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("st_subscribe", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def _(spark, d):
    found = stream.subscribe(stream.read(spark, f"{d}/events.parquet"), ["error", "purchase"]).select("event_id", "event_type")
    return stream.run_available(found)


@query("st_upsert", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    own = stream.read(spark, f"{d}/events.parquet").select("user_id", "event_id", "event_type")
    return stream.upsert_into(own, f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}", ["user_id"], "event_id")


@query("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    """Sessions close when the watermark passes them; as the source ends, the batch form of the same plan gives all."""
    found = stream.sessions(events(spark, d), "6 hours")
    return found.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("k06_exposition", f"SELECT 'weftgraph_counter_' || name || ' ' || value AS line FROM ({_COUNTERS}) UNION ALL SELECT 'weftgraph_gauge_' || event_type || ' ' || max_by(event_id, event_id) FROM events GROUP BY event_type UNION ALL SELECT 'weftgraph_error_' || event_type || ' ' || count(*) FROM events WHERE value IS NULL GROUP BY event_type")
def _(spark, d):
    e = events(spark, d)
    set_ = runtime.gauges(e.select("event_id", F.col("event_id").alias("value"), "event_type"), "event_type")
    failed = e.filter("value IS NULL").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return runtime.exposition(counters(spark, d), set_, failed).select("line")


@query("r03_cursor", "SELECT max(event_id) AS cursor FROM events WHERE event_id > 500")
def _(spark, d):
    return runtime.cursor_after(events(spark, d), 500)


@query("x06_until_first_failure", "WITH f AS (SELECT min(conv_id * 1000 + turn) AS k FROM conversations WHERE turn % 7 = 3 AND conv_id > 5) SELECT conv_id * 1000 + turn AS edit_id, CASE WHEN k IS NULL OR conv_id * 1000 + turn < k THEN 'applied' WHEN conv_id * 1000 + turn = k THEN 'failed' ELSE 'skipped' END AS status FROM conversations, f")
def _(spark, d):
    c = X.table(spark, d, "conversations")
    own = (F.col("conv_id") * 1000 + F.col("turn")).alias("edit_id")
    return edits.until_first_failure(c.select(own, own.alias("ord"), (~((F.col("turn") % 7 == 3) & (F.col("conv_id") > 5))).alias("current")))
