"""Queries of streams' batch twins, composite plans and archive sources, each beside equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules, sequence, tables
from ..session import shared_folder, table
from ..sources import archives
from ..streaming import operators as streams
from . import pipelines
from .registry import query


@query("""
SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type
""")
def distinct_until_changed(spark, sf):
    """ST-2: events whose kind differs from the one before."""
    return streams.changed_only(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1),
c AS (SELECT user_id, min(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, value FROM c WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM l WHERE last <> 'error'
""")
def applied_changes(spark, sf):
    """ST-4: a table after a batch of changes: the last one of each key, of which a removal clears the key."""
    ev = table(spark, sf, "events")
    current = ev.where("event_id % 2 = 1").groupBy("user_id").agg(F.min("value").alias("value"))
    changes = ev.where("event_id % 2 = 0").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("removed"))
    return streams.applied_changes(current, streams.last_changes(changes, ["user_id"], "event_id", "removed"), ["user_id"], "removed")


@query("SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-20' ORDER BY last_ts DESC")
def live_view(spark, sf):
    """ST-5: a filtered and sorted view over the table that a stream keeps."""
    kept = table(spark, sf, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return streams.live_view(kept, F.col("last_ts") > F.lit("2024-01-20").cast("timestamp_ntz"), [F.desc("last_ts"), F.col("user_id")])


@query("""
WITH t AS (SELECT o_custkey AS user_id, arg_max(o_orderstatus, o_orderkey) AS s, min(o_orderdate) FILTER (o_orderkey % 3 = 0) AS claimed FROM orders GROUP BY 1),
b AS (SELECT user_id, ts FROM events UNION ALL SELECT user_id, claimed + INTERVAL 5 SECOND FROM t WHERE claimed IS NOT NULL),
q AS (SELECT user_id FROM b GROUP BY 1 HAVING max(ts) + INTERVAL 2 DAY < TIMESTAMP '2024-01-30')
SELECT user_id, CASE WHEN s = 'P' AND user_id IN (SELECT user_id FROM q) THEN 'Pending' WHEN s = 'P' THEN 'Processing' WHEN s = 'F' THEN 'Completed' ELSE 'Canceled' END AS status, s = 'P' AND user_id IN (SELECT user_id FROM q) AS requeued FROM t
""")
def requeued_tasks(spark, sf):
    """ST-6: processing tasks that went silent are pending again; ended ones stay, a claim counts as a beat."""
    orders = table(spark, sf, "orders")
    status = F.when(F.col("s") == "P", "Processing").when(F.col("s") == "F", "Completed").otherwise("Canceled")
    tasks = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.min(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))).alias("claimed_at")).withColumn("status", status).drop("s")
    out = streams.requeued(tasks, table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", "2 days", F.lit("2024-01-30").cast("timestamp_ntz"))
    return out.select("user_id", "status", "requeued")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def live_beats(spark, sf):
    """ST-7: beats of tasks that are still live."""
    live = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return streams.live_beats(table(spark, sf, "events").select("event_id", "user_id"), live, "user_id").select("event_id")


@query("""
SELECT user_id, arg_max(CASE WHEN event_id % 2 = 0 THEN value END, event_id) FILTER (event_id % 2 = 0) AS total, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS phase FROM events GROUP BY 1
""")
def merged_progress(spark, sf):
    """ST-8: the last value of each field that was given."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(k % 2 == 0, F.col("value")).alias("total"), F.when(k % 3 == 0, F.col("event_type")).alias("phase"))
    return streams.merged_progress(rows, ["user_id"], ["event_id"], ["total", "phase"])


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1")
def first_claims(spark, sf):
    """ST-9: the first claim of each task wins."""
    return streams.first_claims(table(spark, sf, "events").where("event_type = 'click'").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


_STATUS = "CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Processing' WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Completed' ELSE 'Canceled' END"


def _status():
    kind = F.col("event_type")
    return F.when(kind == "view", "Pending").when(kind == "click", "Processing").when(kind == "error", "Failed").when(kind == "purchase", "Completed").otherwise("Canceled")


@query(f"""
SELECT user_id, arg_max({_STATUS}, (ts, event_id)) AS status, count(*) FILTER (event_type = 'error') AS retries, arg_max({_STATUS}, (ts, event_id)) IN ('Completed', 'Canceled') AS ended FROM events GROUP BY 1
""")
def task_lifecycle(spark, sf):
    """ST-10: a task's state after its events, its failures, and whether it has ended."""
    return streams.lifecycle(table(spark, sf, "events").select("user_id", "ts", "event_id", _status().alias("status")), "user_id", ["ts", "event_id"])


@query(f"SELECT event_id, CASE {_STATUS} WHEN 'Processing' THEN 'Pending' ELSE {_STATUS} END AS status FROM events")
def crash_recovery(spark, sf):
    """ST-11."""
    return streams.recovered(table(spark, sf, "events").select("event_id", _status().alias("status")))


@query(f"SELECT event_id AS id FROM events WHERE {_STATUS} = 'Pending' OR ({_STATUS} = 'Failed' AND event_id % 5 < coalesce(CASE WHEN event_id % 2 = 0 THEN 3 END, 0))")
def replayable_tasks(spark, sf):
    """ST-12: pending tasks, and failed ones with retries left by their payload."""
    k = F.col("event_id")
    data = F.when(k % 2 == 0, F.lit(archives.task_payload("UpscaleTask", RetryFor=3))).otherwise(F.lit(archives.task_payload("UpscaleTask")))
    tasks = table(spark, sf, "events").select(k.alias("id"), k.alias("ord"), _status().alias("status"), (k % 5).alias("retry_count"), data.alias("data"))
    return streams.replayable(tasks).select("id")


@query("SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 3 HOUR)) AS run_at FROM events GROUP BY 1")
def scheduled_runs(spark, sf):
    """ST-13: the times of a periodic job between a user's first and last event."""
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return streams.scheduled_runs(spans, "user_id", "a", "b", "3 hours")


@query(f"""
WITH l AS (SELECT user_id, arg_max({_STATUS}, event_id) AS status, arg_max(event_id % 4, event_id) FILTER (event_id % 2 = 0) AS p, arg_max(event_id % 3, event_id) FILTER (event_id % 5 = 0) AS a FROM events GROUP BY 1)
SELECT user_id, status, p AS processed_version, CASE WHEN status IN ('Pending', 'Processing') OR a IS NULL THEN 0 ELSE a END AS applied_version FROM l
""")
def split_state_machine(spark, sf):
    """ST-14: a split state after all its setters."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", _status().alias("status"), F.when(k % 2 == 0, k % 4).alias("processed_version"), F.when(k % 5 == 0, k % 3).alias("applied_version"))
    return streams.split_states(rows, "user_id", ["event_id"])


@query("""
SELECT user_id FROM (SELECT user_id, min(ts) AS ready, max(ts) FILTER (event_type = 'click') AS used FROM events GROUP BY 1) WHERE greatest(ready, coalesce(used, ready)) + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-25'
""")
def idle_inputs(spark, sf):
    """ST-16: prepared inputs that nothing has used for their time to live."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("ready"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("used"))
    return streams.idle_expired(rows, "user_id", "ready", "used", F.lit("2024-01-25").cast("timestamp_ntz"))


# Composite plans.

_INGEST_RULES = [{"pattern": "Ad ", "pattern_type": "Contains", "target_field": "ChapterTitle", "action": "Exclude"}]
_INGEST_RENAMES = [{"ord": 1, "pattern": "^The ", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": ""}]


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS s, CAST(l_partkey % 4 AS INT) AS b, CAST(l_linenumber AS INT) AS k, l_linenumber = 7 AS up FROM lineitem WHERE NOT (l_linenumber = 6 AND l_orderkey % 5 = 0)),
k AS (SELECT o_orderkey AS s, o_orderstatus AS st, o_orderkey % 3 AS m FROM orders WHERE o_orderkey % 8 <> 0),
r AS (SELECT f.*, k.s IS NOT NULL AS known, st, CASE WHEN m = 0 THEN false WHEN m = 1 THEN true ELSE true END AS merges, CASE WHEN m = 2 THEN NULL ELSE m = 1 END AS want FROM f LEFT JOIN k USING (s)),
t AS (SELECT s, greatest(max(b), coalesce(max(CASE WHEN s % 2 = 0 THEN 9 END) FILTER (known), 0)) AS top FROM r GROUP BY s),
d AS (SELECT s, 0 AS b, unnest([0, 1]) AS k FROM k WHERE st = 'P'),
o AS (SELECT r.* FROM r WHERE NOT up AND merges AND (s, b, k) NOT IN (SELECT s, b, k FROM d)),
g AS (SELECT o.*, lag(k) OVER w AS before FROM o JOIN t USING (s) WHERE b < top WINDOW w AS (PARTITION BY s, b ORDER BY k)),
gk AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY s, b ORDER BY k) AS kept, count(*) OVER (PARTITION BY s, b) AS m FROM g),
gs AS (SELECT s, b, count(*) AS n FROM gk WHERE kept AND m > 1 GROUP BY 1, 2),
grp AS (SELECT gk.s, gk.b, gk.k FROM gk JOIN gs USING (s, b) WHERE kept AND m > 1 AND n > 1 AND (gk.s, gk.b) NOT IN (SELECT s, b FROM d)),
au AS (SELECT s, b, k, true AS fresh FROM o WHERE (s, b) IN (SELECT s, b FROM d) UNION ALL SELECT s, b, k, false FROM d),
al AS (SELECT *, lag(k) OVER (PARTITION BY s, b ORDER BY k) AS before FROM au),
ak AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY s, b ORDER BY k) AS kept FROM al),
a AS (SELECT r.*, CASE WHEN up THEN CASE WHEN (s, b, k) IN (SELECT s, b, k FROM r WHERE NOT up) THEN 'attach' ELSE 'unmatched' END
   WHEN (s, b, k) IN (SELECT s, b, k FROM d) AND merges THEN 'skip_merged' WHEN (s, b, k) IN (SELECT s, b, k FROM ak WHERE kept AND fresh) THEN 'append'
   WHEN (s, b, k) IN (SELECT s, b, k FROM grp) THEN 'merge' ELSE 'add' END AS action FROM r)
SELECT 'S' || s AS series, b || '.' || k AS number, up AS is_upscaled, NOT known AS create_series, action, CASE WHEN action = 'merge' THEN 'Chapter ' || b || '.cbz' END AS merged_file,
  CASE WHEN NOT up AND action IN ('add', 'merge') AND (want IS NULL OR want) THEN 'Upscale' END AS next_task FROM a
""")
def ingest(spark, sf):
    """P-1, P-2, Q-14: found chapters filtered, renamed, resolved, merged and routed to actions and tasks."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_partkey") % 4).cast("int").alias("b"), F.col("l_linenumber").cast("int").alias("k")).distinct()
    number = F.concat_ws(".", F.col("b").cast("string"), F.col("k").cast("string"))
    file = F.concat(F.lit("Chapter "), number, F.lit(".cbz"))
    ad = (F.col("k") == 6) & (F.col("s") % 5 == 0)
    found = lines.select(
        file.alias("file_name"), F.concat(F.col("s").cast("string"), F.when(F.col("k") == 7, "/_upscaled/").otherwise("/"), file).alias("relative_path"),
        F.concat(F.lit("The S"), F.col("s")).alias("series"), F.concat(F.when(ad, "Ad ").otherwise(""), F.lit("Chapter "), number).alias("chapter_title"), F.lit("").alias("number"),
    )
    orders = table(spark, sf, "orders").where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("series_id"), "o_orderstatus")
    m = F.col("series_id") % 3
    series = orders.select("series_id", F.when(m != 2, m == 1).alias("should_upscale"), F.when(m != 2, m == 1).alias("merge_chapter_parts"))
    titles = orders.select(F.concat(F.lit("S"), F.col("series_id")).alias("title"), "series_id", F.lit(False).alias("is_alias"))
    existing = orders.where("series_id % 2 = 0").select("series_id", F.lit("9").alias("number"))
    merged = orders.where("o_orderstatus = 'P'").select("series_id", F.lit("0").alias("base"), F.explode(F.array(F.lit("0.0"), F.lit("0.1"))).alias("number"))
    plan = pipelines.ingest_plan(found, _INGEST_RULES, _INGEST_RENAMES, titles, series, existing, merged, F.lit(True), F.lit(True), F.lit(1))
    return plan.select("series", "number", "is_upscaled", "create_series", "action", "merged_file", "next_task")


_CHAPTERS = "SELECT DISTINCT l_suppkey AS series, CAST(l_partkey % 6 AS INT) AS b, CAST(l_linenumber AS INT) AS k FROM lineitem"


@query(f"""
WITH p AS ({_CHAPTERS}), t AS (SELECT *, max(b) OVER (PARTITION BY series) AS top FROM p),
f AS (SELECT *, lag(k) OVER (PARTITION BY series, b ORDER BY k) AS before FROM t WHERE b < top),
ok AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY series, b ORDER BY k) AS kept FROM f),
g AS (SELECT series, b, count(*) AS expected, count(*) FILTER ((series + b + k) % 2 = 0) AS present, count(*) FILTER (k % 3 = 0) AS removed_tasks FROM ok WHERE kept GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'S' || series AS series, CAST(b AS VARCHAR) AS base, 'Ch.' || b || '.cbz' AS merged_file, expected, present, removed_tasks, CASE WHEN present = 0 THEN 'none' WHEN present = expected THEN 'complete' ELSE 'partial' END AS upscaled FROM g WHERE b <> 2
""")
def retroactive_merge(spark, sf):
    """P-3, P-2, J-7, J-20: catalogued chapters that form a merge now, and the state of its upscaled variant."""
    b, k, s = F.col("b"), F.col("k"), F.col("s")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 6).cast("int").alias("b"), F.col("l_linenumber").cast("int").alias("k")).distinct()
    number = F.concat_ws(".", b.cast("string"), k.cast("string"))
    chapters = rows.select((s * 1000 + b * 10 + k).alias("chapter_id"), F.concat(F.lit("S"), s).alias("series"), F.concat(F.lit("Ch."), number, F.lit(".cbz")).alias("file_name"), F.concat(F.lit("Ch."), number).alias("title"), number.alias("number"), s, b, k)
    merged = chapters.select("series", F.lit("2").alias("base"), F.lit("2.1").alias("number")).distinct()
    plan = pipelines.retroactive_merge_plan(chapters.drop("s", "b", "k"), merged, chapters.where((s + b + k) % 2 == 0), chapters.where(k % 3 == 0))
    return plan.select("series", "base", "merged_file", "expected", "present", "removed_tasks", "upscaled")


@query("""
WITH m AS (SELECT o_orderkey AS id, o_orderkey % 9 <> 0 AS has_file, o_orderkey % 2 = 0 AS up FROM orders), l AS (SELECT DISTINCT l_orderkey AS id, CAST(l_linenumber AS INT) AS k FROM lineitem),
n AS (SELECT id, count(*) AS n FROM l GROUP BY 1)
SELECT id AS chapter_id, up AS is_upscaled, id || '-' || k || '.cbz' AS file_name, (k - 1) * 10 AS start_page, 'S%2F' || id || '/' || id || '-' || k || '.cbz' AS path, CASE WHEN (id + k) % 4 = 0 THEN 'replace' ELSE 'restore' END AS action FROM m JOIN l USING (id) WHERE has_file
UNION ALL SELECT id, up, NULL, NULL, NULL, CASE WHEN NOT has_file THEN 'file_missing' WHEN n IS NULL THEN 'no_parts' ELSE 'remove_merged' END FROM m LEFT JOIN n USING (id)
""")
def merge_revert(spark, sf):
    """P-4: undoing merges: parts to restore or replace, merged chapters to remove, and those that cannot be undone."""
    name = lambda k: F.concat(F.col("id").cast("string"), F.lit("-"), k, F.lit(".cbz"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("k")).distinct()
    part = F.struct(name(F.col("k")).alias("file_name"), ((F.col("k") - 1) * 10).alias("start_page_index"), (F.col("k") * 10 - 1).alias("end_page_index"))
    parts = lines.groupBy("id").agg(F.collect_list(part).alias("original_parts"))
    merged = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(parts, "id", "left").select(F.col("id").alias("chapter_id"), F.concat(F.lit("S/"), F.col("id")).alias("series"), (F.col("id") % 2 == 0).alias("is_upscaled"), (F.col("id") % 9 != 0).alias("has_file"), "original_parts")
    present = lines.where((F.col("id") + F.col("k")) % 4 == 0).select(name(F.col("k")).alias("file_name"))
    return pipelines.revert_plan(merged, present).select("chapter_id", "is_upscaled", "file_name", "start_page", "path", "action")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS up, o_orderkey % 13 <> 0 AS has_o, o_orderkey % 3 <> 0 AS has_u, CASE WHEN o_orderkey % 5 <> 0 THEN 1 END AS profile, o_orderkey % 7 = 0 AS tu, o_orderkey % 6 = 0 AS tr FROM orders),
l AS (SELECT DISTINCT l_orderkey AS id, CAST(l_linenumber AS INT) AS k FROM lineitem),
o AS (SELECT id, k FROM l JOIN c USING (id) WHERE has_o AND k < 6), u AS (SELECT id, k FROM l JOIN c USING (id) WHERE has_u AND (k < 6 OR id % 4 = 0) AND NOT (id % 10 = 1 AND k = 1)),
o1 AS (SELECT id FROM o GROUP BY 1), u1 AS (SELECT id FROM u GROUP BY 1),
x AS (SELECT c.*, o1.id IS NOT NULL AS ho, u1.id IS NOT NULL AS hu, (SELECT count(*) FROM o WHERE o.id = c.id AND k NOT IN (SELECT k FROM u WHERE u.id = c.id)) AS missing, (SELECT count(*) FROM u WHERE u.id = c.id AND k NOT IN (SELECT k FROM o WHERE o.id = c.id)) AS extra
  FROM c LEFT JOIN o1 USING (id) LEFT JOIN u1 USING (id)),
y AS (SELECT *, CASE WHEN NOT up AND NOT hu THEN 'Ok' WHEN NOT up AND tu THEN 'MaybeInProgress' WHEN up AND NOT hu THEN 'Missing' WHEN missing = 0 AND extra = 0 THEN CASE WHEN up THEN 'Ok' ELSE 'Corrected' END
  WHEN tr THEN 'MaybeInProgress' WHEN profile IS NOT NULL THEN 'Repair' ELSE 'Invalid' END AS r FROM x),
s AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'NoSplitsFound' ELSE 'Applied' END AS st, CAST(id % 3 AS INT) AS v FROM c WHERE id % 4 <> 1),
f AS (SELECT id, count(*) AS n, max(k % 3) AS newest, count(*) FILTER (k IN (SELECT k FROM o WHERE o.id = l.id)) AS whole FROM l WHERE k > 4 GROUP BY 1),
z AS (SELECT s.id, CASE WHEN st = 'NoSplitsFound' AND coalesce(n, 0) > 0 THEN 'set_detected' WHEN st = 'NoSplitsFound' AND v < 1 THEN 'delete_state' WHEN st = 'Applied' AND coalesce(n, 0) = 0 AND v = 0 THEN 'set_detected'
  WHEN coalesce(n, 0) > 0 AND v = 0 THEN 'set_detected_newest' WHEN st = 'Applied' AND coalesce(n, 0) > 0 AND whole > 0 THEN 'reapply' ELSE 'ok' END AS a FROM s LEFT JOIN f USING (id))
SELECT y.id AS chapter_id, CASE WHEN ho THEN 'Ok' ELSE 'Missing' END AS original_result, CASE WHEN ho THEN r END AS upscaled_result, missing, extra, a AS split_action,
  NOT ho OR coalesce(ho AND r IN ('Missing', 'Corrected', 'Repair', 'Invalid'), false) OR coalesce(a <> 'ok', false) AS changed FROM y LEFT JOIN z ON z.id = y.id
""")
def integrity_check(spark, sf):
    """P-5, FLT-19, ST-15, X-2, A-11: every chapter's checks of its original, its upscaled file and its split state."""
    i, k = F.col("id"), F.col("k")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    path = lambda side: F.concat(F.lit(f"{side}/"), i)
    chapters = orders.select(i.alias("chapter_id"), path("o").alias("original_path"), path("u").alias("upscaled_path"), (F.col("o_orderstatus") == "F").alias("is_upscaled"), F.when(i % 5 != 0, 1).alias("profile_id"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("k")).distinct().join(orders, "id", "left_semi")
    page = F.concat(F.lit("P"), k).alias("page")
    own = lines.where((i % 13 != 0) & (k < 6)).select(path("o").alias("path"), page)
    up = lines.where((i % 3 != 0) & ((k < 6) | (i % 4 == 0)) & ~((i % 10 == 1) & (k == 1))).select(path("u").alias("path"), page)
    tasks = orders.where(i % 7 == 0).select(i.alias("chapter_id"), F.lit("Upscale").alias("kind")).unionByName(orders.where(i % 6 == 0).select(i.alias("chapter_id"), F.lit("Repair").alias("kind")))
    findings = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("k")).distinct().where(k > 4).select(i.alias("chapter_id"), F.concat(F.lit("p"), k).alias("page_file_name"), (k % 3).alias("detector_version"))
    states = orders.where(i % 4 != 1).select(i.alias("chapter_id"), F.when(i % 2 == 0, "NoSplitsFound").otherwise("Applied").alias("status"), (i % 3).cast("int").alias("last_processed_version"))
    return pipelines.integrity_plan(chapters, own.unionByName(up), tasks, findings, states)


@query("""
WITH c AS (SELECT o_orderkey AS id, o_custkey AS s, 'n/' || o_custkey || '%2F' || '/f' || o_orderkey // 5 AS p, o_orderkey % 7 <> 0 AS has FROM orders), n AS (SELECT p, count(*) AS n FROM c GROUP BY 1),
x AS (SELECT c.*, n > 1 OR id % 50 = 0 AS clash FROM c JOIN n USING (p))
SELECT id AS chapter_id, p AS new_path, CASE WHEN clash THEN 'conflict' WHEN bool_or(clash) OVER (PARTITION BY s) THEN 'blocked' WHEN NOT has THEN 'missing' ELSE 'move' END AS action
FROM (SELECT id, s, p, has, clash OR p IN (SELECT p FROM x WHERE id % 50 = 0) AS clash FROM x)
""")
def library_move(spark, sf):
    """P-8, F-6: series that move to another library, as a whole or not at all."""
    k = F.col("o_orderkey")
    file = F.concat(F.lit("f"), F.floor(k / 5))
    chapters = table(spark, sf, "orders").select(k.alias("chapter_id"), F.concat(F.col("o_custkey").cast("string"), F.lit("/")).alias("series"), file.alias("file_name"), F.concat(F.lit("old/"), k).alias("relative_path"), (k % 7 != 0).alias("has_file"))
    existing = table(spark, sf, "orders").where(k % 50 == 0).select(F.concat(F.lit("n/"), F.col("o_custkey"), F.lit("%2F/"), file).alias("path"))
    return pipelines.library_move_plan(chapters, existing, "n/").select("chapter_id", "new_path", "action")


@query("""
WITH r AS (SELECT c_custkey AS sid, CASE WHEN c_custkey % 4 = 0 THEN '..' WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE 'T/' || c_custkey END AS t FROM customer WHERE c_acctbal > 0),
c AS (SELECT o_orderkey AS id, o_custkey AS sid, o_orderkey || '.cbz' AS f, o_orderkey % 6 <> 0 AS has FROM orders), x AS (SELECT c.*, t, CASE WHEN t = '..' THEN '%2E%2E' ELSE replace(t, '/', '%2F') END || '/' || f AS p FROM c JOIN r USING (sid)),
e AS (SELECT 'T%2F' || o_custkey || '/' || o_orderkey || '.cbz' AS p FROM orders WHERE o_orderkey % 20 = 0)
SELECT id AS chapter_id, p AS new_path, CASE WHEN t IN (SELECT c_mktsegment FROM customer) THEN 'title_conflict' WHEN bool_or(p IN (SELECT p FROM e)) OVER (PARTITION BY sid) THEN 'path_conflict' WHEN NOT has THEN 'skip_missing' ELSE 'rename' END AS action FROM x
""")
def series_rename(spark, sf):
    """P-9, J-16, F-6: series that get a new title: a conflict cancels a series, a missing file skips its chapter."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    title = F.when(c % 4 == 0, "..").when(c % 4 == 1, F.col("c_mktsegment")).otherwise(F.concat(F.lit("T/"), c))
    renames = table(spark, sf, "customer").where("c_acctbal > 0").select(c.alias("series_id"), title.alias("new_title"))
    titles = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("title"), F.lit(-1).cast("long").alias("series_id"))
    chapters = table(spark, sf, "orders").select(k.alias("chapter_id"), F.col("o_custkey").alias("series_id"), F.concat(F.lit("old/"), k).alias("relative_path"), F.concat(k.cast("string"), F.lit(".cbz")).alias("file_name"), (k % 6 != 0).alias("has_file"))
    existing = table(spark, sf, "orders").where(k % 20 == 0).select(F.concat(F.lit("T%2F"), F.col("o_custkey"), F.lit("/"), k, F.lit(".cbz")).alias("path"))
    return pipelines.series_rename_plan(chapters, titles, renames, existing).select("chapter_id", "new_path", "action")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS id, CAST(l_linenumber AS INT) AS k FROM lineitem), e AS (SELECT id, k, unnest(CASE WHEN k % 2 = 0 THEN [30, 100] ELSE [100] END) AS bottom FROM p),
s AS (SELECT id, k, lag(bottom, 1, 0) OVER w AS top, bottom, row_number() OVER w AS i, count(*) OVER (PARTITION BY id, k) AS n FROM e WINDOW w AS (PARTITION BY id, k ORDER BY bottom)),
a AS (SELECT id, k, 'original' AS archive, 'Page' || k AS page FROM p UNION ALL SELECT id, k, 'upscaled', 'PAGE' || k FROM p WHERE id % 2 = 0)
SELECT id AS chapter_id, archive, page, CASE WHEN n > 1 THEN page || '_part' || i ELSE page END AS new_page, CAST(CASE WHEN n > 1 THEN top END AS BIGINT) AS top, CAST(CASE WHEN n > 1 THEN bottom END AS BIGINT) AS bottom,
  CASE WHEN n = 1 THEN 'copy' WHEN archive = 'original' THEN 'crop' ELSE 'upscale_segment' END AS action FROM a JOIN s USING (id, k)
""")
def split_apply(spark, sf):
    """P-10, W-8, J-15: the pages of chapters whose splits are applied, in the original archive and the upscaled one."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").cast("int").alias("k")).distinct()
    page = lambda p: F.concat(F.lit(p), F.col("k")).alias("page")
    findings = lines.select("chapter_id", page("page"), F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(30), F.lit(100))).otherwise(F.array(F.lit(0), F.lit(120)))).alias("cut"), F.lit(100).alias("height"))
    return pipelines.split_apply_plan(findings, lines.select("chapter_id", page("Page")), lines.where("chapter_id % 2 = 0").select("chapter_id", page("PAGE")))


@query("""
WITH i AS (SELECT event_id, md5(event_type || user_id % 7) AS h, user_id % 16 AS p, ts FROM events), f AS (SELECT n_nationkey AS id, md5(CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'none' END || n_nationkey % 7) AS h, n_nationkey AS p FROM nation),
m AS (SELECT event_id, arg_min(id, (s, id)) AS id, min(s) AS s FROM (SELECT event_id, id, 0 AS s FROM i JOIN f USING (h) UNION ALL SELECT event_id, id, 1 FROM i JOIN f USING (p)) GROUP BY 1)
SELECT CAST(id AS BIGINT) AS filter_id, count(*) AS n, count(*) FILTER (s = 0) AS exact, max(ts) AS last_matched_at FROM m JOIN i USING (event_id) GROUP BY id
""")
def bulk_image_filter(spark, sf):
    """P-11, J-13, A-17: images that filters remove, by content first, and the filters' counters."""
    ev, n = table(spark, sf, "events"), F.col("n_nationkey")
    pics = ev.select(F.col("event_id").alias("image_id"), F.md5(F.concat("event_type", F.col("user_id") % 7)).alias("content_hash"), (F.col("user_id") % 16).alias("phash"), "ts")
    word = F.when(n % 5 == 0, "click").when(n % 5 == 1, "view").otherwise("none")
    filters = table(spark, sf, "nation").select(n.cast("long").alias("filter_id"), n.alias("ord"), F.md5(F.concat(word, n % 7)).alias("content_hash"), n.cast("long").alias("phash"), F.lit(0).cast("long").alias("occurrence_count"), F.lit(None).cast("timestamp_ntz").alias("last_matched_at"))
    hits, counted = pipelines.image_filter_plan(pics, filters)
    exact = hits.groupBy("filter_id").agg(F.count_if("is_exact").alias("exact"))
    return counted.where("occurrence_count > 0").join(exact, "filter_id").select("filter_id", F.col("occurrence_count").alias("n"), "exact", "last_matched_at")


@query("SELECT p_partkey, p_name AS old_name, regexp_replace(p_name, '^(\\w+) (\\w+)', '\\2 \\1') AS name FROM part WHERE p_name <> regexp_replace(p_name, '^(\\w+) (\\w+)', '\\2 \\1')".replace("\\\\", "\\"))
def rename_preview(spark, sf):
    """P-12: rows that rename rules change, with the names before and after."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("series"), F.lit(None).cast("string").alias("chapter_title"), F.lit("a.cbz").alias("file_name"), F.lit("d/a.cbz").alias("relative_path"))
    shown = rules.rename_preview(rows, [{"ord": 1, "pattern": r"^(\w+) (\w+)", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "$2 ${1}"}])
    return shown.select("p_partkey", F.col("old_series").alias("old_name"), F.col("series").alias("name"))


@query("""
SELECT p_partkey, trim('US$ ' || regexp_replace(p_name, '(\\w+)', '<\\1>')) || '$9' AS name FROM part
""".replace("\\\\", "\\"))
def rename_replacements(spark, sf):
    """O-RW1, U-2: replacement texts: groups by name, the whole match, dollars that name no group, and white space around."""
    renames = [
        {"ord": 1, "pattern": r"^(?<first>\p{L}+)", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "<${first}>"},
        {"ord": 2, "pattern": r"^.*$", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "\t US$ $&$9 "},
        {"ord": 3, "pattern": "(?P<no>x)", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "never"},
    ]
    return table(spark, sf, "part").select("p_partkey", rules.rewritten(renames, "SeriesTitle", F.col("p_name")).alias("name"))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(contains(source, 'src1'), false)")
def rule_order(spark, sf):
    """FLT-4, F-21: rows that a rule before an invalid one drops are dropped; those that reach it are kept."""
    bad = [{"pattern": "src1", "pattern_type": "Contains", "target_field": "path", "action": "Exclude"}, {"pattern": "a[", "pattern_type": "Regex", "target_field": "path", "action": "Exclude"}, {"pattern": "never", "pattern_type": "Contains", "target_field": "path", "action": "Include"}]
    return rules.filter_by_rules(table(spark, sf, "documents").select("doc_id", "source"), bad, {"path": F.coalesce("source", F.lit(""))}).select("doc_id")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R'), u AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'A')
SELECT id AS chapter_id, k AS page, CASE WHEN u.k IS NULL THEN 'upscale' WHEN p.k IS NULL THEN 'drop' ELSE 'keep' END AS action FROM p FULL JOIN u USING (id, k)
""")
def repair(spark, sf):
    """P-13, X-2: the pages of upscaled chapters under repair: upscaled anew, dropped or kept."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return pipelines.repair_plan(lines.where("l_returnflag <> 'R'").drop("l_returnflag"), lines.where("l_returnflag <> 'A'").drop("l_returnflag").distinct())


# Archive sources and sinks, over archives that are made from the tables and written to the shared folder.

_BAD = 5


def _archive_rows(spark, sf):
    """All orders as pages of 20 archives (one page in 7 named wrongly), and a metadata file for every other archive."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("a"), "o_orderkey")
    archive = F.concat(F.lit("c"), F.col("a"), F.lit(".cbz"))
    pages = orders.select(archive.alias("archive"), F.concat(F.lit("in/p"), k, F.when(k % 7 == 0, ".png").otherwise(".JPG")).alias("name"), F.unhex(F.concat(F.lit("FFD8FF"), F.lpad(F.hex(k), 12, "0"))).alias("content"))
    info = F.concat(F.lit("<ComicInfo><Series>S"), F.col("a"), F.lit("</Series><Number>"), F.col("a") % 4, F.lit("</Number></ComicInfo>"))
    named = orders.select("a").distinct().where("a % 2 = 0")
    return pages.unionByName(named.select(archive.alias("archive"), F.lit(archives.INFO).alias("name"), F.encode(info, "UTF-8").alias("content")))


def _archive_folder(spark, sf):
    folder = shared_folder(spark, "archives")
    archives.save_files(archives.write_archives(_archive_rows(spark, sf)), folder)
    extra = spark.createDataFrame([(f"bad/{i}.cbz", bytearray(b"no archive")) for i in range(_BAD)] + [("loose/x/ComicInfo.xml", bytearray(archives.info_xml("Loose", "T", "7"))), ("loose/y/ComicInfo.xml", bytearray(b"<broken")), ("other.CBZ", bytearray(b"")), ("z.txt", bytearray(b""))], "archive string, content binary")
    archives.save_files(extra, folder)
    return folder


@query(f"""
WITH c AS (SELECT DISTINCT o_custkey % 20 AS k FROM orders)
SELECT 'c' || k || '.cbz' AS relative_path, 'Cbz' AS storage_type, CASE WHEN k % 2 = 0 THEN 'S' || k ELSE '' END AS series, CASE WHEN k % 2 = 0 THEN CAST(k % 4 AS VARCHAR) ELSE '' END AS number, false AS failed FROM c WHERE k % 2 = 1 OR NOT starts_with(CAST(k AS VARCHAR), '1')
UNION ALL SELECT 'bad/' || i || '.cbz', 'Cbz', '', '', true FROM range({_BAD}) t(i) UNION ALL SELECT 'loose/x', 'Folder', 'Loose', '7', false UNION ALL SELECT 'loose/y', 'Folder', '', '', true
""")
def found_chapters(spark, sf):
    """SRC-3, SRC-4, SRC-5, SRC-8, SNK-8: chapters of a folder of archives, loose metadata and broken files, filtered by a rule."""
    rule = {"pattern": r"^S1\d*$", "pattern_type": "Regex", "target_field": "MangaTitle", "action": "Exclude"}
    found = archives.find_chapters(spark, _archive_folder(spark, sf), [rule])
    return found.select("relative_path", "storage_type", "series", "number", F.col("error").isNotNull().alias("failed"))


@query(f"""
SELECT 'c' || a || '.cbz' AS archive, 'p' || o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN '.png' ELSE '.jpg' END AS ext, CAST(row_number() OVER (PARTITION BY a ORDER BY 'p' || o_orderkey) - 1 AS INT) AS place, CASE WHEN o_orderkey % 7 = 0 THEN '.jpg' END AS repaired, false AS failed
FROM (SELECT DISTINCT o_custkey % 20 AS a, o_orderkey FROM orders) UNION ALL SELECT i || '.cbz', NULL, NULL, NULL, NULL, true FROM range({_BAD}) t(i)
""")
def archive_pages(spark, sf):
    """SRC-6, SRC-12, SNK-9: the pages of all archives in order, with the extension their first bytes call for."""
    pages = archives.archive_pages(spark, _archive_folder(spark, sf)).withColumn("archive", F.substring_index("archive", "/", -1))
    repairs = archives.extension_repairs(pages).select("archive", "page", F.col("new_ext").alias("repaired"))
    return pages.join(repairs, ["archive", "page"], "left").select("archive", "page", "ext", "place", "repaired", F.col("error").isNotNull().alias("failed"))


@query("""
SELECT 'c' || a || '.cbz' AS archive, count(*) AS entries, md5(string_agg(n, ',' ORDER BY n)) AS digest FROM (SELECT DISTINCT o_custkey % 20 AS a, 'in/p' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.jpg' ELSE '.JPG' END AS n FROM orders
UNION ALL SELECT DISTINCT o_custkey % 20, 'ComicInfo.xml' FROM orders) WHERE a IN (SELECT o_custkey % 20 FROM orders WHERE o_orderkey % 7 = 0) GROUP BY 1
""")
def repaired_archives(spark, sf):
    """SNK-8, SNK-9: archives written anew where an extension is wrong, with a new metadata file; others are not touched."""
    rows = _archive_rows(spark, sf)
    entry = F.col("name")
    wrong = rows.where(entry.rlike("[.]png$"))
    renames = wrong.select("archive", entry.alias("entry"), F.regexp_replace(entry, "[.]png$", ".jpg").alias("new_entry"), F.lit(None).cast("binary").alias("content"))
    info = wrong.select("archive").distinct().select("archive", F.lit(None).cast("string").alias("entry"), F.lit(archives.INFO).alias("new_entry"), F.lit(archives.info_xml("New", "", "1")).alias("content"))
    fixed = archives.rewrite_archives(archives.write_archives(rows), renames.unionByName(info))
    folder = shared_folder(spark, "repaired")
    archives.save_files(fixed, folder)
    listed = archives.find_chapters(spark, folder).where("series = 'New' and number = '1'").select(F.col("file_name").alias("archive"))
    pages = archives.archive_pages(spark, folder).select(F.substring_index("archive", "/", -1).alias("archive"), F.concat(F.lit("in/"), "page", F.when(F.regexp_extract("page", r"(\d+)", 1).cast("long") % 7 == 0, ".jpg").otherwise(".JPG")).alias("n"))
    names = F.sort_array(F.concat(F.collect_list("n"), F.array(F.lit(archives.INFO))))
    listing = pages.groupBy("archive").agg(names.alias("names")).select("archive", F.size("names").cast("long").alias("entries"), F.md5(F.array_join("names", ",")).alias("digest"))
    return listing.join(listed, "archive", "left_semi")


@query("""
SELECT p_partkey, p_size % 3 <> 2 AS is_upscaled, CASE WHEN p_size % 3 = 0 THEN 'x' || p_size END AS name, CASE WHEN p_size % 3 = 0 THEN 2 END AS factor FROM part
""")
def sidecars(spark, sf):
    """SRC-7: a sidecar's profile decides where it parses, else the path does."""
    size = F.col("p_size")
    sidecar = F.when(size % 3 == 0, F.concat(F.lit('{"name": "x'), size, F.lit('", "scalingFactor": 2}')))
    rows = table(spark, sf, "part").select("p_partkey", sidecar.alias("j"), F.when(size % 3 == 1, "a/_upscaled/b").otherwise("a/b").alias("path"))
    made = archives.sidecar_overrides(rows, "j", text.is_upscaled_path(F.col("path")))
    return made.select("p_partkey", "is_upscaled", F.col("profile.name").alias("name"), F.col("profile.scalingFactor").alias("factor"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(props->>'$.k' AS INT) END AS k, CASE WHEN event_id % 4 = 3 THEN 'unreadable result' END AS error FROM events")
def child_results(spark, sf):
    """SRC-10: a child's JSON, also where it stands amid other output; what does not parse is a row with an error."""
    i = F.col("event_id")
    told = F.when(i % 4 == 0, F.col("props")).when(i % 4 == 1, F.concat(F.lit("warming up\n"), "props", F.lit(" done"))).when(i % 4 == 2, F.concat(F.lit(" "), "props")).otherwise("no result {")
    return archives.parsed_results(table(spark, sf, "events").select("event_id", told.alias("t")), "t", "k int").drop("t")


@query("""
WITH c AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS n, string_agg(l_returnflag || CAST(l_quantity AS INT), ',' ORDER BY l_returnflag, CAST(l_quantity AS INT)) AS t FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2)
SELECT k, md5(string_agg(t, '' ORDER BY n)) AS digest FROM c GROUP BY 1
""")
def assembled_uploads(spark, sf):
    """SRC-11, SNK-7: uploads put together in chunk order, dropped where the task is no longer live."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"), "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "q"))), lambda x: F.concat(x["l_returnflag"], x["q"])), ",")
    chunks = lines.groupBy("k", "n").agg(F.encode(told, "UTF-8").alias("content"))
    dead = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    live = tables.delete_ids(chunks.select("k").distinct(), dead, "k")
    whole = archives.assemble_chunks(streams.live_beats(chunks, live, "k"), "k", "n", "content")
    return whole.select("k", F.md5("content").alias("digest"))


@query("SELECT p_partkey, p_size * 2 AS doubled, upper(p_name) AS loud FROM part")
def script_rows(spark, sf):
    """U-5: an external program as a row function."""
    program = "import sys, json\nfor x in sys.stdin:\n r = json.loads(x)\n print(json.dumps({'p_partkey': r['p_partkey'], 'doubled': r['p_size'] * 2, 'loud': r['p_name'].upper()}))"
    import sys

    return archives.script_rows(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"), [sys.executable, "-c", program], "p_partkey long, doubled int, loud string")


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN CAST(user_id * 2 AS VARCHAR) WHEN 'view' THEN '"seen"' END AS result, CASE event_type WHEN 'error' THEN 'ZeroDivisionError' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'KeyError' END AS error FROM events
""")
def job_types(spark, sf):
    """U-3: tasks run the job of their payload's type; a failing or unknown one is a row with its error."""
    jobs = archives.Jobs()
    jobs.register("click")(lambda p: p["user"] * 2)
    jobs.register("view")(lambda p: "seen")
    jobs.register("error")(lambda p: 1 // 0)
    tasks = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("$type"), F.col("user_id").alias("user"))).alias("data"))
    return jobs.run(tasks).select("event_id", "result", "error")


@query(f"""
WITH p AS ({_CHAPTERS}), f AS (SELECT *, lag(k) OVER (PARTITION BY series, b ORDER BY k) AS before FROM p),
ok AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY series, b ORDER BY k) AS kept FROM f)
SELECT 'all' AS kind, series, CAST(b AS VARCHAR) AS base, count(*) AS parts FROM ok WHERE kept GROUP BY 2, 3 HAVING count(*) > 1
UNION ALL SELECT 'low', series, CAST(b AS VARCHAR), count(*) FROM ok WHERE kept AND b < 2 GROUP BY 2, 3 HAVING count(*) > 1
""")
def injected_choice(spark, sf):
    """U-4, P-2: what may be merged is the caller's choice: all chapters, or those a function lets."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series"), F.concat_ws(".", (F.col("l_partkey") % 6).cast("string"), F.col("l_linenumber").cast("string")).alias("number")).distinct()
    chapters = rows.select("series", "number", F.lit("f").alias("file_name"), F.lit("t").alias("title"))
    none = spark.createDataFrame([], "series long, base string, number string")
    out = None
    for kind, choice in (("all", None), ("low", lambda rows, _: rows.where("base < 2"))):
        valid, _, _ = pipelines.merge_plan(chapters, none, eligible=choice)
        part = valid.groupBy("series", "base").agg(F.count("*").alias("parts")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS m, CAST(l_linenumber AS INT) AS k FROM lineitem)
SELECT m AS merge_id, 1 || '.' || k AS number, CAST(coalesce(sum(k + 2) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_page FROM l
""")
def merged_pages(spark, sf):
    """P-2, W-6: the pages of a merge's parts one after another."""
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("merge_id"), F.concat(F.lit("1."), F.col("l_linenumber")).alias("number"), F.lit("f").alias("file_name"), (F.col("l_linenumber") + 2).cast("long").alias("n_pages")).distinct()
    return pipelines.merged_pages(parts).select("merge_id", "number", "start_page")


def _compact_source(spark, sf):
    folder = shared_folder(spark, "many-files")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(20).write.mode("overwrite").parquet(folder)
    return folder


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(1 AS BIGINT) AS files FROM orders")
def compacted_table(spark, sf):
    """SNK-11: many small files written anew as few."""
    from ..session import compact

    out = compact(spark, _compact_source(spark, sf), shared_folder(spark, "compact") + "/table", 1 << 30)
    return out.select("o_orderkey", F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("f").alias("files"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS INT) AS n FROM p WHERE l_linenumber % 2 = 1 AND l_orderkey % 3 = 0
""")
def unnumbered_additions(spark, sf):
    """W-5, Q-17: candidates that come in because their metadata number equals that of an accepted one, the empty one too."""
    k = F.col("l_linenumber").cast("int")
    rows = table(spark, sf, "lineitem").select("l_orderkey", k.alias("n"), F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("x"), F.col("l_orderkey"))).alias("number")).distinct()
    accepted = spark.createDataFrame([("",), ("none",)], "number string")
    return sequence.unnumbered_additions(rows.where("n % 2 = 1"), accepted, "number", "number").select("l_orderkey", "n")
