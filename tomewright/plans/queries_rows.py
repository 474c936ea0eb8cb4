"""Queries of filters, projections, sorts, paging, aggregates and snapshot mutations, each beside equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import match, tables
from ..session import table
from .registry import query


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events WHERE event_type = 'click' AND value > 10 GROUP BY user_id")
def table_scan(spark, sf):
    """SRC-1, SRC-2, A-1: a scan whose filter and columns reach the file."""
    return table(spark, sf, "events").where("event_type = 'click' and value > 10").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def status_filter(spark, sf):
    """FLT-1."""
    return tables.where_all(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", None, F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')")
def severity_filter(spark, sf):
    """FLT-6: events from a level on, by the order of levels."""
    return tables.at_least_level(table(spark, sf, "events"), "purchase", "event_type", ["view", "click", "signup", "purchase", "error"]).select("event_id", "event_type")


@query("""
SELECT 'live' AS kind, o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2 UNION ALL SELECT 'all', o_custkey, count(*) FROM orders GROUP BY 2
""")
def soft_delete_filter(spark, sf):
    """FLT-5: live rows, and all rows where the filter is bypassed."""
    rows = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("deleted"))
    sides = [tables.not_deleted(rows, bypass).groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, bypass in (("live", False), ("all", True))]
    return match.union_all(*sides)


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN c_nationkey + 1000 END, n_regionkey) AS profile, coalesce(CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 = 1 END, n_regionkey > 2) AS merges
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def effective_profile(spark, sf):
    """FLT-9, PRJ-2, J-1: a customer's own setting, else that of the parent."""
    rows = match.with_parents(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), [(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "c_nationkey", "n_nationkey", True)])
    nation, region = F.col("c_nationkey"), F.col("n_regionkey")
    own, wish = F.when(F.col("c_acctbal") < 0, nation + 1000), F.when(nation % 3 > 0, nation % 3 == 1)
    return rows.select("c_custkey", tables.inherited(own, region).alias("profile"), tables.inherited(wish, region > 2).alias("merges"))


@query("""
SELECT event_id, s = 'Pending' OR (s = 'Failed' AND event_id % 4 < CAST(props->>'$.k' AS INT) % 5) AS retry
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'Pending' WHEN 'error' THEN 'Failed' ELSE 'Completed' END AS s FROM events)
""")
def retry_eligible(spark, sf):
    """FLT-10: pending rows, and failed ones with retries left by their payload."""
    status = F.when(F.col("event_type") == "view", "Pending").when(F.col("event_type") == "error", "Failed").otherwise("Completed")
    most = F.get_json_object("props", "$.k").cast("int") % 5
    return table(spark, sf, "events").select("event_id", tables.retryable(status, F.col("event_id") % 4, most).alias("retry"))


@query("SELECT doc_id, v IS NULL OR v < 1 AS stale FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS v FROM labels GROUP BY 1) USING (doc_id)")
def stale_states(spark, sf):
    """FLT-11: documents without a state, or with one of an older version."""
    states = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("v"))
    return table(spark, sf, "documents").select("doc_id").join(states, "doc_id", "left").select("doc_id", tables.is_stale(F.col("v"), 1).alias("stale"))


@query("""
SELECT l_orderkey, bool_or(CASE WHEN l_quantity = 1 THEN true ELSE l_extendedprice / 1000 / (l_quantity - 1) > 2.4 END) AS has_strip FROM lineitem GROUP BY 1
""")
def strip_pages(spark, sf):
    """FLT-12: orders with a line much 'taller' than 'wide'; an unreadable one (no width) counts as one."""
    pages = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") - 1).alias("w"), (F.col("l_extendedprice") / 1000).alias("h"))
    return tables.has_strip(pages, ["l_orderkey"], "w", "h")


@query("""
SELECT p_partkey, CASE lower(ltrim(e, '.')) WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'tif' THEN 'image/tiff' END AS mime,
       coalesce(lower(ltrim(e, '.')) IN ('jpg', 'png', 'webp', 'tif'), false) AS allowed, p_name LIKE '%ed' OR p_name LIKE '%e' AS ends
FROM (SELECT p_partkey, p_name, list_extract(['.JPG', 'png', '.gif', '.webp', 'TIF', NULL], CAST(p_partkey % 6 + 1 AS INT)) AS e FROM part)
""")
def extension_whitelist(spark, sf):
    """FLT-14, FLT-15, F-12: extensions in any case with or without a dot, their MIME types, and suffixes of names."""
    kinds = F.array(*(F.lit(e) for e in (".JPG", "png", ".gif", ".webp", "TIF", None)))
    ext = F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.mime_type(ext).alias("mime"), text.is_image_extension(ext).alias("allowed"), text.ends_with_any(F.col("p_name"), ["ed", "e"]).alias("ends"))


@query("SELECT doc_id FROM documents WHERE (CASE WHEN lang <> 'en' THEN lang END) IS NULL AND n_chars > 0")
def missing_hashes(spark, sf):
    """FLT-16: rows with content whose hash is still to be filled in."""
    return table(spark, sf, "documents").where(tables.needs_hash(F.col("n_chars"), F.when(F.col("lang") != "en", F.col("lang")))).select("doc_id")


@query("""
SELECT event_id, user_id AS key FROM events JOIN (SELECT c_custkey, c_acctbal > 0 AS active, CASE WHEN c_nationkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + c_nationkey * INTERVAL 1 DAY END AS expires_at FROM customer) ON user_id = c_custkey
WHERE active AND (expires_at IS NULL OR expires_at >= ts)
""")
def valid_api_keys(spark, sf):
    """J-17, FLT-17: requests whose key is active and has not expired; no expiry is valid for ever."""
    nation = F.col("c_nationkey")
    until = F.when(nation % 3 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=nation))
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("active"), until.alias("expires_at"))
    return match.valid_keys(table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts"), keys, F.col("ts")).select("event_id", "key")


@query("SELECT s_suppkey, '/root/' || s_suppkey || '/' || s_name || '.cbz' AS path, CASE WHEN s_nationkey % 2 = 0 THEN '/up/' || s_name END AS upscaled FROM supplier")
def derived_paths(spark, sf):
    """PRJ-1: paths under a root; a missing part makes no path."""
    root = F.concat(F.lit("/root/"), F.col("s_suppkey"), F.lit("/"))
    up = F.when(F.col("s_nationkey") % 2 == 0, "/up")
    return table(spark, sf, "supplier").select("s_suppkey", tables.derived_path(root, F.concat("s_name", F.lit(".cbz"))).alias("path"), tables.derived_path(up, F.col("s_name")).alias("upscaled"))


@query("SELECT p_partkey, p_name AS series, upper(p_brand) AS title, CAST(p_size + 1 AS VARCHAR) AS number FROM part")
def copied_records(spark, sf):
    """PRJ-4: a record copied with some fields changed."""
    record = F.struct(F.col("p_name").alias("series"), F.col("p_brand").alias("title"), F.col("p_size").cast("string").alias("number"))
    made = tables.replaced(record, title=F.upper("p_brand"), number=(F.col("p_size") + 1).cast("string"))
    return table(spark, sf, "part").select("p_partkey", made.alias("r")).select("p_partkey", "r.*")


@query("""
(SELECT 'up' AS side, doc_id, lang FROM documents ORDER BY lang ASC NULLS FIRST, doc_id LIMIT 30)
UNION ALL (SELECT 'down', doc_id, lang FROM documents ORDER BY lang DESC NULLS LAST, doc_id OFFSET 30 LIMIT 30)
""")
def null_sort_keys(spark, sf):
    """PRJ-5, S-6: pages by a nullable key in both directions."""
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    up = tables.sort_and_page(rows, {"lang": F.col("lang")}, "lang", False, 0, 30, "doc_id")
    down = tables.sort_and_page(rows, {"lang": F.col("lang")}, "lang", True, 1, 30, "doc_id")
    return match.union_all(up.withColumn("side", F.lit("up")), down.withColumn("side", F.lit("down")))


@query("""
SELECT event_id, t IN ('UpscaleTask', 'RepairUpscaleTask') AS upscale, event_type = 'click' AND user_id % 2 = 0 AS wanted
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'UpscaleTask' WHEN 'view' THEN 'RepairUpscaleTask' WHEN 'error' THEN 'ScanIngestTask' ELSE 'Other' END AS t FROM events)
""")
def task_payloads(spark, sf):
    """PRJ-6, F-23, J-5, J-6: tagged JSON payloads, their category, and a look-up by type and ids of a JSON array."""
    kind = F.when(F.col("event_type") == "click", "UpscaleTask").when(F.col("event_type") == "view", "RepairUpscaleTask").when(F.col("event_type") == "error", "ScanIngestTask").otherwise("Other")
    tasks = table(spark, sf, "events").select("event_id", "user_id", F.to_json(F.struct(kind.alias("$type"), F.col("user_id").alias("ChapterId"))).alias("data"))
    even = table(spark, sf, "events").where("user_id % 2 = 0").agg(F.to_json(F.sort_array(F.collect_set("user_id"))).alias("list")).select(match.json_ids(F.col("list")).alias("id"))
    found = match.json_lookup(tasks, "data", "UpscaleTask", even).select("event_id", F.lit(True).alias("w"))
    return tasks.join(found, "event_id", "left").select("event_id", tables.is_upscale_task(F.col("data")).alias("upscale"), F.coalesce("w", F.lit(False)).alias("wanted"))


@query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P') FROM orders
""")
def queue_buckets(spark, sf):
    """A-4, A-21: counts per status, for each customer and for all, in one pass each."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    each = tables.status_buckets(rows, "o_orderstatus", ["F", "O", "P"], ["o_custkey"])
    return each.unionByName(tables.status_buckets(rows, "o_orderstatus", ["F", "O", "P"]).withColumn("o_custkey", F.lit(None).cast("long")))


@query("""
SELECT 'front' AS what, min(o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'front of none', -1 UNION ALL SELECT 'last of none', 0
UNION ALL SELECT 'last', max(o_orderkey) FROM orders WHERE o_orderstatus = 'P' UNION ALL (SELECT 'next', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1)
""")
def queue_ends(spark, sf):
    """S-10, S-11, A-5: a queue's first row and the positions before and after all rows; an empty queue has them too."""
    queue = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    none = queue.where("o_orderkey < 0")
    parts = [
        (tables.front_position(queue, "o_orderkey"), "front"), (tables.front_position(none, "o_orderkey"), "front of none"), (tables.last_position(none, "o_orderkey"), "last of none"),
        (tables.last_position(queue, "o_orderkey"), "last"), (tables.dequeue(queue, "o_totalprice", "o_orderkey").select("o_orderkey"), "next"),
    ]
    out = None
    for frame, what in parts:
        row = frame.select(F.lit(what).alias("what"), F.col(frame.columns[0]).cast("long").alias("k"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS filter_id, CAST(n_regionkey + coalesce(n, 0) AS BIGINT) AS occurrence_count, coalesce(t, TIMESTAMP '2023-12-31') AS last_matched_at
FROM nation LEFT JOIN (SELECT user_id % 31 AS u, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1) ON u = n_nationkey
""")
def match_counters(spark, sf):
    """A-17: stored counters plus new matches, and the time of the last."""
    filters = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("filter_id"), F.col("n_regionkey").cast("long").alias("occurrence_count"), F.lit("2023-12-31").cast("timestamp_ntz").alias("last_matched_at"))
    hits = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 31).alias("filter_id"), "ts")
    return tables.match_counters(filters, hits)


@query("SELECT l_orderkey, max(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS BIGINT)) AS pixels FROM lineitem GROUP BY 1")
def most_pixels(spark, sf):
    """A-18: the largest area among a group's pages."""
    pages = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("w"), F.bround("l_extendedprice").cast("long").alias("h"))
    return tables.most_pixels(pages, ["l_orderkey"], "w", "h")


@query("""
WITH a AS (SELECT l_orderkey, list({'n': l_linenumber, 'f': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS parts FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1)
SELECT min(l_orderkey) AS first_key, count(*) AS n FROM a GROUP BY parts
""")
def equal_part_arrays(spark, sf):
    """A-20: orders whose arrays of parts are equal, found by an order-sensitive hash."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    parts = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("parts"))
    return parts.groupBy(tables.order_hash(F.col("parts")).alias("h")).agg(F.min("l_orderkey").alias("first_key"), F.count("*").alias("n")).drop("h")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS p, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS modified_at FROM orders
UNION ALL SELECT -o_orderkey - 1, 'new', TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-01' FROM orders WHERE o_orderkey % 7 = 0
""")
def stamped_upsert(spark, sf):
    """SNK-1: changed rows keep their creation stamp, new ones get it, both the change stamp."""
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    rows = tables.stamped(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), "o_orderdate"), F.col("o_orderdate")).drop("o_orderdate")
    changed = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("changed").alias("p"))
    new = rows.where("o_orderkey % 7 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("p"))
    return tables.upsert(rows, changed.unionByName(new), ["o_orderkey"], now)


@query("""
SELECT l_orderkey AS chapter_id, l_linenumber AS page FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'P'
""")
def replaced_findings(spark, sf):
    """SNK-4: all findings of a key give way to its new ones."""
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("page"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chapter_id"), F.lit(-1).alias("page"))
    return tables.replace_for_keys(old, new, ["chapter_id"])


@query("SELECT n_nationkey AS id, n_name AS name, n_nationkey = 3 OR n_regionkey = 4 AS deleted FROM nation UNION ALL SELECT 103, 'new version', false")
def profile_versions(spark, sf):
    """SNK-5: a new version in, the old one soft-deleted."""
    profiles = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 4).alias("deleted"))
    return tables.replace_profile(profiles, 3, spark.createDataFrame([(103, "new version", False)], "id int, name string, deleted boolean"))


@query("""
WITH r AS (SELECT *, length(props) * 100 AS size FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
c AS (SELECT *, (sum(size) OVER (ORDER BY ts, event_id) - size) // 20000 AS epoch FROM r)
SELECT event_id FROM c WHERE epoch = (SELECT max(epoch) FROM c)
""")
def log_retention(spark, sf):
    """SNK-6: the last seven days, and of these what was written since the size limit last emptied the log."""
    recent = tables.retain_recent(table(spark, sf, "events").select("event_id", "ts", (F.length("props") * 100).cast("long").alias("size")), "ts")
    return tables.since_last_limit(recent, "ts", "event_id", "size", 20_000).select("event_id")


@query("""
SELECT 'customer' AS what, count(*) AS n FROM customer WHERE c_nationkey > 4 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <= 4)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <= 4)
""")
def cascade_delete(spark, sf):
    """SNK-10: parents go with all their children."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    kept = tables.cascade_delete(customer, customer.where("c_nationkey <= 4"), "c_custkey", {"orders": (table(spark, sf, "orders").select("o_custkey"), "o_custkey"), "events": (table(spark, sf, "events").select("user_id"), "user_id")})
    out = None
    for name, frame in kept.items():
        row = frame.agg(F.count("*").alias("n")).withColumn("what", F.lit(name or "customer"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT c_custkey, coalesce(n, 0) AS children FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY children DESC, c_custkey LIMIT 25")
def most_children(spark, sf):
    """S-7: a page of customers by their number of orders."""
    return tables.by_child_count(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey"), "c_custkey", "o_custkey").limit(25)


@query("""
SELECT name, row_number() OVER (ORDER BY upper(name), name) AS rank FROM (SELECT n_name AS name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT n_name || 'x' FROM nation)
""")
def ignore_case_rank(spark, sf):
    """S-8, X-5: names in ordinal order that ignores case."""
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    names = match.union_distinct(match.union_distinct(nation, nation.select(F.lower("name").alias("name"))), nation.select(F.concat("name", F.lit("x")).alias("name")))
    # the names of a dimension of fixed size: one partition
    return names.select("name", F.row_number().over(Window.orderBy(*tables.ignore_case_order("name"))).cast("long").alias("rank"))


@query("SELECT CAST(17 AS BIGINT) AS n")
def any_rows(spark, sf):
    """S-9: a limit without an order: how many rows come is all that is defined."""
    return tables.any_rows(table(spark, sf, "orders").select("o_orderkey"), 17).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 60
""")
def pending_first(spark, sf):
    """S-12: pending rows before all others."""
    status = F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Done")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy(tables.pending_first(status), "o_orderkey").limit(60)


@query("""
SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey OFFSET 40 LIMIT 40
""")
def queue_order(spark, sf):
    """S-1, S-5: the second page of a queue by rank of status, date and key."""
    named = F.create_map(F.lit("F"), F.lit("Completed"), F.lit("O"), F.lit("Processing"), F.lit("P"), F.lit("Pending"))
    order = [tables.status_rank(named[F.col("o_orderstatus")]), F.desc("o_orderdate"), F.col("o_orderkey")]
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").orderBy(*order).offset(40).limit(40).select("o_orderkey")


@query("""
WITH f AS (SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '_1') OR n_nationkey IN (SELECT r_regionkey * 5 FROM region WHERE contains(lower(r_name || '_' || r_regionkey), '_1')))
SELECT n_nationkey, n_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY n_name DESC, n_nationkey OFFSET 3 LIMIT 3
""")
def search_page_total(spark, sf):
    """FLT-3, S-5, S-6: a search over titles and aliases: one page, and how many rows there are in all."""
    aliases = table(spark, sf, "region").select((F.col("r_regionkey") * 5).alias("manga_id"), F.concat("r_name", F.lit("_"), F.col("r_regionkey")).alias("title"))
    found = tables.title_search(table(spark, sf, "nation").select("n_nationkey", "n_name"), aliases, " _1 ", "n_name", "n_nationkey")
    return tables.page_with_total(found, {"name": F.col("n_name")}, "name", True, 1, 3, "n_nationkey")


@query("""
SELECT p_partkey, to_base64(encode(p_name)) AS encoded, p_name AS decoded, 200.0::DOUBLE / greatest(p_size * 7, p_size * 3 + 40) AS ratio, CASE WHEN p_size % 3 = 0 THEN 0.5 WHEN p_size % 2 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS scale FROM part
""")
def encoded_thumbnails(spark, sf):
    """F-14, F-17: base64 there and back, a thumbnail's ratio, and the smaller of two scales."""
    size = F.col("p_size")
    encoded = text.encode_base64(F.encode("p_name", "UTF-8"))
    return table(spark, sf, "part").select(
        "p_partkey", encoded.alias("encoded"), F.decode(text.decode_base64(encoded), "UTF-8").alias("decoded"),
        numbers.thumbnail_ratio(size * 7, size * 3 + 40, 200).alias("ratio"),
        numbers.combined_scale(F.when(size % 2 == 0, F.lit(0.75)), F.when(size % 3 == 0, F.lit(0.5))).alias("scale"),
    )


@query("SELECT event_id, ts + INTERVAL 90 MINUTE < (SELECT max(ts) FROM events) AS due FROM events")
def due_times(spark, sf):
    """F-24: a time some minutes on, compared with now (the newest event stands for it)."""
    events = table(spark, sf, "events").select("event_id", "ts")
    newest = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(newest)).select("event_id", numbers.is_due(F.col("ts"), F.lit(90), F.col("now")).alias("due"))  # one row


@query("SELECT p_partkey, p_name = '' OR p_size % 3 <> 0 AS valid FROM part")
def pattern_validity(spark, sf):
    """F-21: which patterns are valid: made from names, every third with an open bracket."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).alias("r"))
    checks = {r: text.valid_regex(pattern) for r, pattern in ((0, "a["), (1, r"(?<n>\p{L}+) $"), (2, " "))}
    return rows.select("p_partkey", F.element_at(F.create_map(*(F.lit(x) for pair in checks.items() for x in pair)), F.col("r")).alias("valid"))
