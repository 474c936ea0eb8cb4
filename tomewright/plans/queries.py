"""Registered queries of the catalogue operators on the driver's tables, each beside equal DuckDB SQL.

Every docstring names the operators it exercises. Queries read whole tables; a limit stands only where it is the feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import images, numbers, text
from ..operators import match, rules, sequence, tables
from ..session import table
from ..streaming import operators as streams
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY user_id
""")
def latest_state_per_key(spark, sf):
    """W-10, ST-10: each user's last event and number of errors."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    last = sequence.latest_per_key(ev, ["user_id"], ["ts", "event_id"], ["status"])
    failures = ev.select("user_id", "ts", "event_id", F.when(F.col("status") == "error", "Failed").otherwise(F.col("status")).alias("status"))
    return last.join(streams.lifecycle(failures, "user_id", ["ts", "event_id"]).select("user_id", F.col("retries").alias("errors")), "user_id")


@query("""
WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT user_id, last_ts FROM l WHERE last_ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events)
""")
def heartbeat_timeout(spark, sf):
    """ST-6: users silent for over a day at the newest event."""
    return streams.heartbeat_timeouts(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", "1 day")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k
""")
def debounce_sessions(spark, sf):
    """ST-1: the last event of each burst with an hour of silence after it."""
    return streams.debounce(table(spark, sf, "events"), ["user_id"], "ts", "event_type", "1 hour")


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, r, event_id, ts AS last, true AS emitted FROM e WHERE r = 1
  UNION ALL
  SELECT e.user_id, e.r, e.event_id, CASE WHEN e.ts - f.last >= INTERVAL 1 DAY THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 1 DAY
  FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, event_id FROM f WHERE emitted
""")
def throttle_progress(spark, sf):
    """ST-3: events at least a day after the last one emitted for the user."""
    return streams.throttle(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 86_400, "event_id").select("user_id", "event_id")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total
FROM events WHERE CAST(props->>'$.k' AS BIGINT) % 3 = 0 GROUP BY event_type
""")
def json_type_lookup(spark, sf):
    """J-5: rows by a JSON field."""
    found = match.json_lookup(table(spark, sf, "events").select("event_type", "props"), "props", field="k").where("json_id % 3 = 0")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("json_id").alias("total"))


@query("""
SELECT count(*) AS n FROM events WHERE CAST(props->>'$.k' AS BIGINT) IN (SELECT value::BIGINT FROM json_each('[1,2,3,5,8,13,21]'))
""")
def json_array_semi(spark, sf):
    """J-6: rows whose JSON id is in a JSON array."""
    ids = spark.range(1).select(match.json_ids(F.lit("[1,2,3,5,8,13,21]")).alias("id"))
    return match.json_lookup(table(spark, sf, "events").select("props"), "props", ids=ids, field="k").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT CASE WHEN count(*) > 100 THEN min(ts) END AS cut FROM (SELECT ts FROM p ORDER BY ts DESC LIMIT 101))
SELECT event_id, ts FROM p, c WHERE cut IS NULL OR ts > cut
""")
def retain_newest_100(spark, sf):
    """W-14, SNK-3: purchases newer than the 101st newest."""
    return sequence.keep_newest(table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "ts"), "ts", 100)


@query("""
SELECT event_id, round(quantile_cont(value, 0.1) OVER w, 6) AS p10, round(quantile_cont(value, 0.9) OVER w, 6) AS p90
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)
""")
def rolling_quantile_64(spark, sf):
    """A-16: quantiles over a user's last 64 values."""
    w = numbers.last_samples(["user_id"], [F.col("ts"), F.col("event_id")])
    return table(spark, sf, "events").select("event_id", F.round(numbers.rolling_quantile(F.col("value"), 0.1, w), 6).alias("p10"), F.round(numbers.rolling_quantile(F.col("value"), 0.9, w), 6).alias("p90"))


@query("SELECT event_type, round(avg(value) + 1.96 * coalesce(stddev_samp(value), 0), 6) AS p95 FROM events GROUP BY event_type")
def p95_upper(spark, sf):
    """A-15."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(numbers.upper_bound_95(F.col("value")), 6).alias("p95"))


@query("""
WITH d AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us, event_id - lag(event_id) OVER w AS pages
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, us / 1000000 / pages AS seconds_per_page FROM d WHERE us > 0 AND pages > 0
""")
def progress_rate(spark, sf):
    """W-11: time per step between a user's successive rows, where both moved forward."""
    rates = sequence.progress_rates(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    return rates.select("user_id", "event_id", "seconds_per_page")


@query("""
WITH s AS (SELECT user_id, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) AS p95, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY user_id),
r AS (SELECT e.user_id, e.event_id, e.event_id % 40 AS remaining, 40 AS total, s.* EXCLUDE (user_id) FROM events e JOIN s USING (user_id)),
d AS (SELECT *, remaining <= 10 OR remaining <= 5 OR (p90 > 0 AND remaining * p95 <= p90) AS prefetch,
      remaining <= 0 OR NOT (p10 > 0) OR 1000 / p10 >= remaining * p95 AS claim FROM r)
SELECT user_id, event_id, claim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM d WHERE prefetch) WHERE k = 1
""")
def prefetch_decision(spark, sf):
    """F-19, F-20, ST-18: each user's first row at which fetching ahead is due, and whether a download is claimed then."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "value")
    stats = ev.groupBy("user_id").agg(numbers.upper_bound_95(F.col("value")).alias("p95"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.9).alias("p90"))
    rows = ev.join(stats, "user_id").withColumn("remaining", F.col("event_id") % 40)
    due = numbers.should_prefetch(F.col("remaining"), F.lit(40), F.col("p95"), F.col("p90"))
    claim = numbers.should_claim(F.col("remaining"), numbers.download_seconds(F.lit(1000.0), F.col("p10"), F.lit(None).cast("double")), F.col("p95"))
    return streams.first_trigger(rows.withColumn("claim", claim), "user_id", ["event_id"], due).select("user_id", "event_id", "claim")


@query("""
SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, count(*) AS n,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY o_orderstatus
""")
def status_buckets(spark, sf):
    """PRJ-3: orders by status with the status' rank."""
    named = F.create_map(F.lit("F"), F.lit("Completed"), F.lit("O"), F.lit("Processing"), F.lit("P"), F.lit("Pending"))
    rows = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    return rows.select(F.col("o_orderstatus").alias("status"), tables.status_rank(named[F.col("o_orderstatus")]).alias("rank"), "n", "n_urgent")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
f AS (SELECT *, l_linenumber - 1 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r,
      count(*) OVER (PARTITION BY l_orderkey) AS m, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS lo FROM p),
x AS (SELECT *, lag(k) OVER (PARTITION BY l_orderkey ORDER BY k) AS b FROM f),
ok AS (SELECT *, CASE WHEN b IS NULL THEN k IN (0, 1) WHEN b = 0 THEN k IN (1, 2) ELSE k = b + 1 END AS good FROM x),
keep AS (SELECT *, bool_and(good) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS kept FROM ok)
SELECT l_orderkey, l_linenumber FROM keep WHERE kept AND m >= 2
""")
def consecutive_prefix(spark, sf):
    """W-1, A-8: an order's line numbers as parts order.0, order.1, ...; the prefix without a gap."""
    parts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    numbered = parts.withColumns({"number": F.concat_ws(".", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") - 1).cast("string")), "base": F.col("l_orderkey").cast("string")})
    return sequence.consecutive_prefix(numbered, ["l_orderkey"], "number", "base").select("l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, count(DISTINCT l_linenumber) <> count(l_linenumber) AS repeats FROM lineitem GROUP BY 1
""")
def repeated_numbers(spark, sf):
    """A-8: orders whose line numbers repeat."""
    return sequence.has_repeats(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderkey // 100 AS b, max(o_orderkey // 100) OVER (PARTITION BY o_custkey) AS t FROM orders) WHERE b < t
""")
def latest_excluded(spark, sf):
    """W-4: a customer's orders but those of the largest whole number."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey").withColumn("number", (F.col("o_orderkey") / 100).cast("string"))
    return sequence.without_latest(rows, ["o_custkey"], "number").select("o_custkey", "o_orderkey")


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pages FROM lineitem GROUP BY ALL),
o AS (SELECT *, CAST(coalesce(sum(pages) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_page FROM l)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, start_page, start_page + pages - 1 AS end_page,
       CASE WHEN length(CAST(start_page AS VARCHAR)) >= 4 THEN CAST(start_page AS VARCHAR) ELSE lpad(CAST(start_page AS VARCHAR), 4, '0') END AS label FROM o
""")
def page_offsets(spark, sf):
    """W-6: running page ranges of an order's lines and their four-digit labels."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("long")).alias("pages"))
    placed = sequence.page_offsets(lines, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "pages")
    return placed.select(*keys[:4], "start_page", "end_page", sequence.page_label(F.col("start_page")).alias("label"))


@query("""
WITH RECURSIVE p AS (SELECT l_orderkey, CAST(l_linenumber * 7 AS BIGINT) AS s, CAST(l_linenumber * 7 + CAST(l_quantity AS BIGINT) - 10 AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, n) AS r FROM p),
f AS (SELECT l_orderkey, r, s, CASE WHEN e < s THEN s + greatest(0, n - 1) ELSE e END AS e FROM o WHERE r = 1
  UNION ALL
  SELECT o.l_orderkey, o.r, CASE WHEN o.s <= f.e THEN f.e + 1 ELSE o.s END,
         CASE WHEN o.s <= f.e THEN f.e + 1 + greatest(0, o.n - 1) WHEN o.e < o.s THEN o.s + greatest(0, o.n - 1) ELSE o.e END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.r = f.r + 1)
SELECT l_orderkey, CAST(max(e) AS BIGINT) AS last_page, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM f GROUP BY l_orderkey
""")
def range_repair(spark, sf):
    """W-7: an order's page ranges, each repaired against its repaired predecessor."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long") * 7
    ranges = table(spark, sf, "lineitem").select("l_orderkey", k.alias("start"), (k + q - 10).alias("end"), q.alias("pages"))
    fixed = sequence.repair_ranges(ranges, "l_orderkey")
    return fixed.groupBy("l_orderkey").agg(F.max("end").alias("last_page"), F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("""
WITH c AS (SELECT p_partkey, p_size * 10 AS h, unnest([p_size * 3, p_size * 7, p_size * 3, 0, p_size * 12]) AS cut FROM part),
e AS (SELECT DISTINCT p_partkey, CAST(cut AS BIGINT) AS bottom FROM c WHERE cut > 0 AND cut < h UNION SELECT p_partkey, CAST(h AS BIGINT) FROM c)
SELECT p_partkey, CAST(lag(bottom, 1, 0) OVER w AS BIGINT) AS top, bottom, '_part' || row_number() OVER w AS part FROM e WINDOW w AS (PARTITION BY p_partkey ORDER BY bottom)
""")
def crop_segments(spark, sf):
    """W-8: segments between cuts; repeated and outside cuts do not count."""
    size = F.col("p_size")
    cuts = table(spark, sf, "part").select("p_partkey", (size * 10).alias("h"), F.explode(F.array(size * 3, size * 7, size * 3, F.lit(0), size * 12)).alias("cut"))
    return sequence.crop_segments(cuts, ["p_partkey"], "cut", "h")


@query("""
SELECT p_partkey, CAST(i AS BIGINT) AS segment, CAST(i * ((p_size * 10) // 3) AS BIGINT) AS top,
       CAST(CASE WHEN i = 2 THEN p_size * 10 ELSE (i + 1) * ((p_size * 10) // 3) END AS BIGINT) AS bottom
FROM part, range(3) t(i)
""")
def equal_segments(spark, sf):
    """W-9."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).alias("h"))
    return sequence.equal_segments(rows, "h", F.lit(3)).select("p_partkey", "segment", "top", "bottom")


FILTER_RULES = [
    {"pattern": "src1", "pattern_type": "Contains", "target_field": "path", "action": "Exclude"},
    {"pattern": "^(en|de)$", "pattern_type": "Regex", "target_field": "series", "action": "Include"},
    {"pattern": "tion", "pattern_type": "Contains", "target_field": "title", "action": "Include"},
]


@query("""
SELECT doc_id FROM documents
WHERE NOT coalesce(contains(source, 'src1'), false) AND (coalesce(regexp_matches(lang, '^(en|de)$'), false) OR coalesce(contains(text, 'tion'), false))
""")
def rule_filter(spark, sf):
    """FLT-4, U-1: documents that filter rules keep."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return rules.filter_by_rules(docs, FILTER_RULES, {"path": F.col("source"), "series": F.col("lang"), "title": F.col("text")}).select("doc_id")


RENAME_RULES = [
    {"ord": 1, "pattern": r"(\w+) (\w+)", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "$2-$1"},
    {"ord": 2, "pattern": "a", "pattern_type": "Contains", "target_field": "SeriesTitle", "replacement": " A "},
    {"ord": 3, "pattern": "[", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": "x"},
    {"ord": 4, "pattern": r"\s+$", "pattern_type": "Regex", "target_field": "SeriesTitle", "replacement": ""},
]


@query(r"""
SELECT p_partkey, trim(replace(trim(regexp_replace(p_name, '(\w+) (\w+)', '\2-\1', 'g')), 'a', ' A ')) AS renamed FROM part
""")
def rename_rules(spark, sf):
    """O-RW1, U-2: names rewritten by rules in order; a bad pattern changes nothing."""
    return table(spark, sf, "part").select("p_partkey", rules.rewritten(RENAME_RULES, "SeriesTitle", F.col("p_name")).alias("renamed"))


@query("""
SELECT c_custkey, n AS number, split_part(n, '.', 1)::DECIMAL(28,0)::VARCHAR AS base FROM (
  SELECT c_custkey, regexp_extract('Chapter ' || c_custkey || '.' || c_nationkey, '(?i)ch(?:apter)?\\.?\\s*(\\d+)(?:[.-](\\d+))?', 1) || '.' ||
         regexp_extract('Chapter ' || c_custkey || '.' || c_nationkey, '(?i)ch(?:apter)?\\.?\\s*(\\d+)(?:[.-](\\d+))?', 2) AS n FROM customer)
""".replace("\\\\", "\\"))
def number_extract(spark, sf):
    """F-1, F-3: numbers and base numbers of chapter titles."""
    title = F.concat(F.lit("Chapter "), F.col("c_custkey"), F.lit("."), F.col("c_nationkey"))
    n = text.extract_number(title)
    return table(spark, sf, "customer").select("c_custkey", n.alias("number"), text.base_number(n).alias("base"))


@query("""
SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^(\\D+)', 1), CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT)) AS rank
FROM (SELECT DISTINCT p_brand FROM part)
""".replace("\\\\", "\\"))
def natural_sort_rank(spark, sf):
    """S-3: brands in natural order (the number compares as a number)."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    order = Window.orderBy(text.natural_key_strict(F.col("p_brand")))  # one partition: a rank over few distinct names
    return brands.select("p_brand", F.row_number().over(order).cast("long").alias("rank"))


@query("""
SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 ORDER BY p_size DESC, p_partkey OFFSET 20 LIMIT 20
""")
def search_page(spark, sf):
    """FLT-2, FLT-3, S-5, S-6: the second page of a search."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    found = tables.title_search(tables.where_all(parts, None, F.col("p_size") > 10), None, " A ", "p_name", "p_partkey")
    return tables.sort_and_page(found, {"size": F.col("p_size")}, "size", True, 1, 20, "p_partkey")


@query("""
WITH t AS (SELECT n_name AS title, n_nationkey AS k, 0 AS a FROM nation UNION ALL SELECT r_name, 100 + r_regionkey, 1 FROM region UNION ALL SELECT lower(n_name), n_nationkey, 1 FROM nation),
w AS (SELECT DISTINCT n_name AS title FROM nation UNION SELECT r_name FROM region UNION SELECT lower(n_name) FROM nation UNION SELECT 'nowhere')
SELECT w.title, CAST(arg_min(t.k, (t.a, t.k)) AS INT) AS k FROM w LEFT JOIN t USING (title) GROUP BY w.title
""")
def alias_resolve(spark, sf):
    """J-3: names resolved through primary titles, then aliases."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    primary = nation.select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("k"))
    alias = region.select(F.col("r_name").alias("title"), (100 + F.col("r_regionkey")).alias("k")).unionByName(nation.select(F.lower("n_name").alias("title"), F.col("n_nationkey").alias("k")))
    wanted = primary.select("title").union(alias.select("title")).union(spark.createDataFrame([("nowhere",)], "title string")).distinct()
    return match.resolve_by_title(wanted, match.title_map(primary, alias, "k", "title"), "title", "k").select("title", F.col("k").cast("int").alias("k"))


@query("""
WITH x AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM x) THEN 'conflict' ELSE 'valid' END AS kind FROM orders
""")
def semi_anti_conflicts(spark, sf):
    """J-7: orders with and without returned lines."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    valid, conflict = match.split_conflicts(orders, seen, ["o_orderkey"])
    return valid.withColumn("kind", F.lit("valid")).unionByName(conflict.withColumn("kind", F.lit("conflict")))


@query("""
SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus <> 'F') AS original, max(o_orderkey) FILTER (o_orderstatus = 'F') AS variant FROM orders GROUP BY o_custkey
""")
def pair_variants(spark, sf):
    """J-9: each customer's newest open and finished order."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("done"))
    return match.pair_variants(rows, ["o_custkey"], "done", "o_orderkey")


@query("""
WITH f AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c/' || o_orderkey || '.cbz' ELSE 'c/_upscaled/' || o_orderkey || '.cbz' END AS path, o_orderkey % 2 = 1 AS up, o_orderkey AS k FROM orders),
p AS (SELECT 'c/' || k || '.cbz' AS canonical, max(path) FILTER (NOT up) AS original, max(path) FILTER (up) AS variant FROM f GROUP BY 1),
ch AS (SELECT 'c/' || o_orderkey || '.cbz' AS canonical, o_orderstatus = 'F' AS is_up FROM orders WHERE o_orderkey % 3 <> 0)
SELECT canonical, CASE WHEN ch.canonical IS NULL AND original IS NULL THEN 'ignored' WHEN ch.canonical IS NULL THEN 'create'
  WHEN variant IS NOT NULL AND NOT is_up THEN 'mark_upscaled' ELSE 'none' END AS action
FROM p LEFT JOIN ch USING (canonical)
""")
def orphan_reconcile(spark, sf):
    """J-8, J-9, F-7, FLT-13, P-6: files without a row, and rows whose upscaled file is new."""
    from .pipelines import orphan_plan

    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    files = orders.select(F.when(k % 2 == 0, F.concat(F.lit("c/"), k, F.lit(".cbz"))).otherwise(F.concat(F.lit("c/_upscaled/"), k, F.lit(".cbz"))).alias("path"))
    chapters = orders.where(k % 3 != 0).select(F.concat(F.lit("c/"), k, F.lit(".cbz")).alias("path"), (F.col("o_orderstatus") == "F").alias("is_upscaled"))
    return orphan_plan(files, chapters).select("canonical", "action")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_returnflag = 'R')
SELECT k, v, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, v, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def set_diff_both_ways(spark, sf):
    """X-2: parts a supplier has on one side only."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"), "l_returnflag")
    return match.set_difference(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["k"], "v")


@query("""
WITH a AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k, a IS NOT DISTINCT FROM b AS equal, a IS NOT NULL AND b IS NOT NULL AS comparable FROM a FULL JOIN b USING (k)
""")
def sequences_equal(spark, sf):
    """A-12: whether an order's accepted and returned line numbers are the same."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag")
    return match.sequences_equal(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["k"], "l_linenumber")


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, sf):
    """F-9, J-13's exact pass: texts that repeat."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _sign_hash() -> Column:
    """64 bits, the signs of 64 components; the last one is the sign of the number."""
    bits = [F.when(F.col("embedding")[i] > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


@query("""
WITH h AS (SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0 END FOR i IN range(64)]) AS UBIGINT) AS p FROM embeddings),
f AS (SELECT vec_id AS filter_id, p AS q FROM h WHERE vec_id % 10 = 0)
SELECT h.vec_id AS image_id, arg_min(f.filter_id, f.filter_id) AS filter_id FROM h JOIN f ON bit_count(xor(h.p, f.q)) <= 9 GROUP BY 1
""")
def near_hash_match(spark, sf):
    """F-11, J-13: the first filter whose hash is near each image's; bands are join keys, so there is no cross product."""
    hashed = table(spark, sf, "embeddings").select("vec_id", _sign_hash().alias("p"))
    pics = hashed.select(F.col("vec_id").alias("image_id"), F.concat(F.lit("i"), "vec_id").alias("content_hash"), F.col("p").alias("phash"))
    filters = hashed.where("vec_id % 10 = 0").select(F.col("vec_id").alias("filter_id"), F.col("vec_id").alias("ord"), F.concat(F.lit("f"), "vec_id").alias("content_hash"), F.col("p").alias("phash"))
    return match.match_filters(pics, filters, 85.0).select("image_id", "filter_id")


@query("""
SELECT user_id, coalesce(bool_and(event_type = 'error'), false) AS all_failed, bool_or(event_type = 'error') AS any_failed,
       coalesce(array_to_string(list_sort(list(DISTINCT e) FILTER (e IS NOT NULL)), '; '), '') AS errors
FROM (SELECT *, CASE WHEN event_type = 'error' THEN props END AS e FROM events) GROUP BY user_id
""")
def distinct_string_agg(spark, sf):
    """A-11, A-13, A-14: failures of each user and their distinct messages."""
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return tables.failure_summary(rows, ["user_id"])


@query("""
SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name, n_name) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_totals(spark, sf):
    """A-6, A-7, J-1: customers by region and nation with all totals."""
    joined = match.with_parents(table(spark, sf, "customer").select("c_nationkey"), [(table(spark, sf, "nation"), "c_nationkey", "n_nationkey", True), (table(spark, sf, "region"), "n_regionkey", "r_regionkey", True)])
    return tables.three_level_totals(joined, ["r_name", "n_name"])


@query("""
SELECT d.doc_id, coalesce(d.lang = 'en', false) AND (l.toxic IS NULL OR l.toxic <> 0) AND l.quality IS NOT NULL AS ingest,
       coalesce(l.toxic = 1, d.lang = 'en', false) AND l.quality IS NOT NULL AS merge
FROM documents d LEFT JOIN (SELECT doc_id, min(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)
""")
def gates(spark, sf):
    """FLT-7, FLT-8: both upscale gates on tri-state flags."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    lib, series, profile = F.col("lang") == "en", F.col("toxic") == 1, F.col("quality")
    return rows.select("doc_id", tables.ingest_gate(lib, series, profile).alias("ingest"), tables.merge_gate(lib, series, profile).alias("merge"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 0 AS found, bool_or(l_linestatus = 'F') AS up FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(found, false) AND o_orderstatus = 'O' THEN 'ApplySplits'
  WHEN coalesce(found, false) AND o_orderstatus = 'F' AND o_totalprice > 100000 THEN CASE WHEN up THEN 'RepairUpscale' ELSE 'Upscale' END
  WHEN NOT coalesce(found, false) AND o_totalprice > 100000 THEN CASE WHEN coalesce(up, false) THEN 'RepairUpscale' ELSE 'Upscale' END END AS next_task
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def next_task_routing(spark, sf):
    """FLT-18: what follows detection, from an order's lines and state."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count_if(F.col("l_returnflag") == "R") > 0).alias("found"), F.bool_or(F.col("l_linestatus") == "F").alias("up"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left")
    mode = F.when(F.col("o_orderstatus") == "O", "DetectAndApply").when(F.col("o_orderstatus") == "F", "DetectOnly")
    no = F.lit(False)
    return rows.select("o_orderkey", tables.next_task(F.coalesce("found", no), mode, F.col("o_totalprice") > 100000, F.coalesce("up", no)).alias("next_task"))


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS flagged, o_orderkey % 3 <> 0 AS has_file, o_orderkey % 5 = 0 AS open_task, o_orderkey % 4 <> 0 AS eq, o_orderkey % 7 <> 0 AS prof, o_orderkey % 11 = 0 AS rep FROM orders)
SELECT k, CASE WHEN NOT flagged AND NOT has_file THEN 'Ok' WHEN NOT flagged AND open_task THEN 'MaybeInProgress' WHEN flagged AND NOT has_file THEN 'Missing'
  WHEN eq THEN CASE WHEN flagged THEN 'Ok' ELSE 'Corrected' END WHEN rep THEN 'MaybeInProgress' WHEN prof THEN 'Repair' ELSE 'Invalid' END AS outcome FROM r
""")
def upscaled_integrity(spark, sf):
    """FLT-19: the outcome of an integrity check."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("k"), "o_orderstatus")
    k = F.col("k")
    return rows.select("k", tables.upscaled_integrity(F.col("o_orderstatus") == "F", k % 3 != 0, k % 5 == 0, k % 4 != 0, k % 7 != 0, k % 11 == 0).alias("outcome"))


@query("""
SELECT o_custkey AS source, count(*) AS chapters, count(*) FILTER (o_orderstatus <> 'P') AS movable,
  CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'flag_empty' WHEN count(*) FILTER (o_orderstatus <> 'P') = count(*) THEN 'move_all' ELSE 'skip' END AS plan
FROM orders GROUP BY 1
""")
def move_plan(spark, sf):
    """FLT-20, P-7: all-or-nothing moves."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderstatus") == "P").alias("exists_at_target"))
    from .pipelines import series_merge_plan

    return series_merge_plan(rows)


@query("""
WITH s AS (SELECT doc_id AS chapter_id, CASE min(quality) WHEN 0 THEN 'NoSplitsFound' ELSE 'Applied' END AS status, min(toxic) AS version FROM labels GROUP BY 1),
f AS (SELECT doc_id AS chapter_id, count(*) AS n, CAST(max(n_chars % 3) AS INT) AS newest FROM documents WHERE lang <> 'en' GROUP BY 1),
x AS (SELECT s.*, coalesce(n, 0) AS findings, newest FROM s LEFT JOIN f USING (chapter_id)),
a AS (SELECT *, CASE WHEN status = 'NoSplitsFound' AND findings > 0 THEN 'set_detected' WHEN status = 'NoSplitsFound' AND version < 1 THEN 'delete_state'
  WHEN status = 'Applied' AND findings = 0 AND version = 0 THEN 'set_detected' WHEN findings > 0 AND version = 0 THEN 'set_detected_newest'
  WHEN status = 'Applied' AND findings > 0 THEN 'reapply' ELSE 'ok' END AS action FROM x)
SELECT chapter_id, status, findings, action, CASE WHEN action = 'set_detected_newest' THEN newest ELSE version END AS new_version FROM a
""")
def state_reconcile(spark, sf):
    """ST-15, A-10: states against their findings and files."""
    docs = table(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("chapter_id"), F.concat(F.lit("P"), F.col("doc_id")).alias("page_file_name"), (F.col("n_chars") % 3).cast("int").alias("detector_version"))
    states = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("chapter_id")).agg(F.when(F.min("quality") == 0, "NoSplitsFound").otherwise("Applied").alias("status"), F.min("toxic").cast("int").alias("last_processed_version"))
    return tables.reconcile_split_state(states, docs, docs.select("chapter_id", F.lower("page_file_name").alias("page_file_name")), 1)


@query("""
SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS profile, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_nationkey + 100 ELSE s_nationkey END, 'supplier' FROM supplier
""")
def profile_repoint(spark, sf):
    """SNK-2, SNK-5: foreign keys moved to new versions of a dimension."""
    mapping = table(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("old_id"), (F.col("n_nationkey") + 100).alias("new_id"))
    a = tables.repoint(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", mapping)
    b = tables.repoint(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", mapping)
    return a.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("profile"), F.lit("customer").alias("kind")).unionByName(b.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("profile"), F.lit("supplier").alias("kind")))


@query("""
SELECT l_orderkey AS k, count(*) AS expected, count(*) FILTER (p) AS present, CASE WHEN count(*) FILTER (p) = 0 THEN 'none' WHEN count(*) FILTER (p) = count(*) THEN 'complete' ELSE 'partial' END AS coverage
FROM (SELECT DISTINCT a.l_orderkey, a.l_linenumber, b.l_orderkey IS NOT NULL AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a
  LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') b USING (l_orderkey, l_linenumber)) GROUP BY 1
""")
def part_coverage(spark, sf):
    """J-20: how many of an order's parts are shipped."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_linestatus")
    return match.coverage(lines.select("k", "l_linenumber").distinct(), lines.where("l_linestatus = 'F'"), ["k"], "l_linenumber")


@query("""
SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer
""")
def child_counts(spark, sf):
    """A-1, J-12: customers with their number of orders, 0 for none."""
    return match.with_counts(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").select("o_custkey"), "c_custkey", "o_custkey")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def dedupe_first(spark, sf):
    """A-9: each customer's first order by an explicit rank."""
    return match.dedupe_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'requeued' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_orderkey % 10 = 0
""")
def snapshot_upsert(spark, sf):
    """SNK-2, SNK-3, X-3: a snapshot updated, rows deleted, new ones added."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    kept = tables.delete_ids(tables.update_where(rows, F.col("o_orderkey") % 2 == 0, o_orderpriority=F.lit("requeued")), rows.where("o_orderkey % 10 = 0"), "o_orderkey")
    return match.union_all(kept, rows.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("new").alias("o_orderpriority")))


@query("""
SELECT p_partkey, CASE WHEN w <= 100 AND h <= 100 THEN w WHEN w > h THEN 100 ELSE CAST(round_even(100.0 * (w / h::DOUBLE), 0) AS INT) END AS width,
       CASE WHEN w <= 100 AND h <= 100 THEN h WHEN w > h THEN CAST(round_even(100.0 / (w / h::DOUBLE), 0) AS INT) ELSE 100 END AS height,
       round(60.0 * greatest(1.0, w::BIGINT * h * 1000 / 1000000.0), 6) AS timeout
FROM (SELECT p_partkey, p_size * 7 AS w, p_size * 3 + 40 AS h FROM part)
""")
def fit_sizes(spark, sf):
    """F-13, F-18: sizes fitted to a largest side and time-outs by size."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).alias("w"), (F.col("p_size") * 3 + 40).alias("h"))
    fitted = numbers.fit_within(F.col("w"), F.col("h"), 100)
    return rows.select("p_partkey", fitted["width"].alias("width"), fitted["height"].alias("height"), F.round(numbers.timeout_seconds(F.lit(60.0), F.col("w").cast("long") * F.col("h") * 1000), 6).alias("timeout"))


@query("""
SELECT s_suppkey, replace(replace(s_name || '/' || s_suppkey || '..', '/', '%2F'), chr(0), '%00') AS escaped FROM supplier
""")
def path_escape(spark, sf):
    """F-6: names as directory segments."""
    return table(spark, sf, "supplier").select("s_suppkey", text.escape_directory_name(F.concat("s_name", F.lit("/"), F.col("s_suppkey"), F.lit(".."))).alias("escaped"))


_PIXELS = "SELECT vec_id, unnest(embedding)::DOUBLE AS p, (generate_subscripts(embedding, 1) - 1) // 8 AS y, (generate_subscripts(embedding, 1) - 1) % 8 AS x FROM embeddings"


@query(f"""
WITH e AS ({_PIXELS}), m AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos((2 * i + 1) * k * pi() / 16) AS w FROM range(8) a(k), range(8) b(i)),
c AS (SELECT vec_id, v.k AS v, h.k AS h, sum(p * v.w * h.w) AS c FROM e JOIN m v ON v.i = y JOIN m h ON h.i = x GROUP BY 1, 2, 3),
o AS (SELECT vec_id, (list_sort(list(c))[32] + list_sort(list(c))[33]) / 2 AS median FROM c GROUP BY 1),
s AS (SELECT vec_id, sum(CASE WHEN c > median THEN 1::HUGEINT << (63 - h * 8 - v)::HUGEINT ELSE 0 END) AS bits FROM c JOIN o USING (vec_id) GROUP BY 1)
SELECT vec_id, CAST(CASE WHEN bits >= 9223372036854775808 THEN bits - 18446744073709551616 ELSE bits END AS BIGINT) AS phash FROM s
""")
def phash_dct(spark, sf):
    """F-10: perceptual hashes of vectors read as 8×8 images."""
    return table(spark, sf, "embeddings").select("vec_id", images.phash_udf("embedding").alias("phash"))


@query(f"""
WITH e AS ({_PIXELS}), f AS (SELECT vec_id, u, v, sqrt(sum(p * cos(2 * pi() * (u * y + v * x) / 8)) ** 2 + sum(p * sin(2 * pi() * (u * y + v * x) / 8)) ** 2) / 8 AS m FROM e, range(8) a(u), range(8) b(v) GROUP BY 1, 2, 3),
g AS (SELECT vec_id, r, avg(m) AS p FROM (SELECT vec_id, m, u, v, CAST(round(sqrt(least(u, 8 - u) ** 2 + least(v, 8 - v) ** 2)) AS INT) AS r FROM f) WHERE r BETWEEN 1 AND 4 GROUP BY 1, 2),
t AS (SELECT vec_id, greatest(6 * avg(p) FILTER (r >= 3), 0.01 * max(p)) AS least FROM g GROUP BY 1),
l AS (SELECT vec_id, max(r) FILTER (p >= least) AS last FROM g JOIN t USING (vec_id) GROUP BY 1)
SELECT vec_id, CASE WHEN last / 4.0 < 0.9 THEN greatest(0.5, last / 4.0)::DOUBLE END AS scale FROM l
""")
def fft_cliff(spark, sf):
    """F-15, A-19: spectral cliffs of vectors read as 8×8 images."""
    return table(spark, sf, "embeddings").select("vec_id", images.cliff_scale_udf("embedding").alias("scale"))


@query(f"""
WITH e AS ({_PIXELS}), k AS (SELECT unnest([-1, 0, 1]) AS d, unnest([exp(-2.0), 1.0, exp(-2.0)]) / (1 + 2 * exp(-2.0)) AS w),
b AS (SELECT e.vec_id, c.y, c.x, sum(e.p * i.w * j.w) AS p FROM (SELECT y, x FROM range(8) a(y), range(8) b(x)) c, k i, k j, e
  WHERE e.y = greatest(0, least(7, c.y + i.d)) AND e.x = greatest(0, least(7, c.x + j.d)) GROUP BY 1, 2, 3),
s AS (SELECT unnest([-1, 1, 0, 0, 0]) AS dy, unnest([0, 0, -1, 1, 0]) AS dx, unnest([1, 1, 1, 1, -4]) AS w),
l AS (SELECT b.vec_id, c.y, c.x, sum(b.p * s.w) AS p FROM (SELECT y, x FROM range(8) a(y), range(8) b(x)) c, s, b WHERE b.y = greatest(0, least(7, c.y + s.dy)) AND b.x = greatest(0, least(7, c.x + s.dx)) GROUP BY 1, 2, 3)
SELECT vec_id, round(stddev_samp(p), 6) AS sharpness FROM l GROUP BY 1
""")
def laplacian_sharpness(spark, sf):
    """F-16: sharpness of vectors read as 8×8 images."""
    return table(spark, sf, "embeddings").select("vec_id", F.round(images.sharpness_udf("embedding"), 6).alias("sharpness"))


from . import queries_flow, queries_match, queries_rows  # noqa: E402, F401  they register their queries
