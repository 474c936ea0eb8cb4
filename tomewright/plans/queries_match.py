"""Queries of joins, set operators, sequences, natural order and text functions, each beside equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import images, text
from ..operators import match, sequence, tables
from ..session import table
from .registry import query


@query("""
SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events, o.list AS order_list, e.list AS event_list FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS list FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS list FROM events GROUP BY 1) e ON user_id = c_custkey
""")
def sibling_collections(spark, sf):
    """J-2: two collections of one parent, each gathered apart: neither multiplies the other."""
    children = {"o": (table(spark, sf, "orders"), "o_custkey", ["o_orderkey"]), "e": (table(spark, sf, "events"), "user_id", ["event_id"])}
    rows = match.with_children(table(spark, sf, "customer").select("c_custkey"), "c_custkey", children)
    listed = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("c_custkey", F.when(F.col("o").isNotNull(), size("o")).otherwise(0).alias("orders"), F.when(F.col("e").isNotNull(), size("e")).otherwise(0).alias("events"), listed("o", "o_orderkey").alias("order_list"), listed("e", "event_id").alias("event_list"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def listed_ids(spark, sf):
    """J-4: a semi-join by id list."""
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return match.only_ids(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ids, "o_orderkey")


@query("""
SELECT p_partkey, coalesce(x.f, 'path/' || p_partkey) AS path FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS f FROM lineitem WHERE l_quantity > 45 GROUP BY 1) x ON l_partkey = p_partkey
""")
def lookup_fallback(spark, sf):
    """J-10: a looked-up value or the one that would be computed."""
    known = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("path"))
    return match.with_fallback(table(spark, sf, "part").select("p_partkey"), known, ["p_partkey"], "path", F.concat(F.lit("path/"), F.col("p_partkey")))


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY lower(n_name) ORDER BY n_nationkey DESC) AS r FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT lower(n_name), n_nationkey + 50 FROM nation WHERE n_nationkey % 2 = 0)),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY n_nationkey) AS r FROM nation) WHERE r = 1)
SELECT c_custkey, g.n_nationkey AS exact, f.n_nationkey AS any_case FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) ELSE lower(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) c
LEFT JOIN g ON g.n_name = c.name LEFT JOIN f ON lower(f.n_name) = lower(c.name) AND f.r = 1
""")
def first_by_name(spark, sf):
    """J-11, J-15: the first row with the same name, exactly and in any case, by an explicit order."""
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).otherwise(F.lower("n_name")).alias("name"))
    exact = match.first_match(rows, nation.withColumnRenamed("n_nationkey", "exact"), ["name"], [F.col("exact")])
    others = nation.unionByName(nation.where("n_nationkey % 2 = 0").select(F.lower("name").alias("name"), (F.col("n_nationkey") + 50).alias("n_nationkey")))
    found = match.first_match(exact, others.withColumnRenamed("n_nationkey", "any_case"), ["name"], [F.desc("any_case")], ignore_case=True)
    return found.select("c_custkey", "exact", "any_case")


@query("""
SELECT DISTINCT p.p_partkey, b.l_linenumber FROM part p JOIN (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) b ON b.l_partkey = p.p_partkey
WHERE starts_with(lower('Page' || b.l_partkey || '_PART' || b.l_linenumber), lower('PAGE' || p.p_partkey || '_part'))
""")
def part_files(spark, sf):
    """J-14: files that are parts of a page, by the page's name in any case: an equi-join, not a prefix scan."""
    files = table(spark, sf, "lineitem").select("l_linenumber", F.concat(F.lit("Page"), F.col("l_partkey"), F.lit("_PART"), F.col("l_linenumber")).alias("file")).distinct()
    pages = table(spark, sf, "part").select("p_partkey", F.lower(F.concat(F.lit("PAGE"), F.col("p_partkey"))).alias("page"))
    return files.withColumn("page", match.part_pages(F.col("file"))).join(pages, "page").select("p_partkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_partkey <> a.p_partkey)")
def title_clashes(spark, sf):
    """J-16: rows whose title another row has too."""
    return match.title_clashes(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("""
WITH o AS (SELECT p_partkey AS chapter_id, p_name || '/x' AS file_name, p_name AS title FROM part WHERE p_partkey % 2 = 0),
u AS (SELECT p_partkey AS upscaled_id, CASE p_partkey % 3 WHEN 0 THEN p_name || '/x' ELSE p_name || p_partkey END AS file_name, p_name AS title FROM part),
h AS (SELECT upscaled_id, 0 AS r, chapter_id FROM u JOIN o ON u.file_name = o.file_name OR replace(u.file_name, '/', '%2F') = o.file_name UNION ALL SELECT upscaled_id, 1, chapter_id FROM u JOIN o ON u.title = o.title)
SELECT upscaled_id, arg_min(chapter_id, (r, chapter_id)) AS chapter_id FROM u LEFT JOIN h USING (upscaled_id) GROUP BY 1
""")
def match_originals(spark, sf):
    """J-18: each upscaled file's original by file name or escaped file name, else the first of equal title."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    originals = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("chapter_id"), F.concat("p_name", F.lit("/x")).alias("file_name"), F.col("p_name").alias("title"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("/x"))).otherwise(F.concat("p_name", F.col("p_partkey")))
    files = part.select(F.col("p_partkey").alias("upscaled_id"), name.alias("file_name"), text.escape_file_name(name).alias("escaped"), F.col("p_name").alias("title"))
    return match.match_originals(files, originals, "file_name", "escaped", "title").select("upscaled_id", "chapter_id")


@query("""
WITH e AS (SELECT lower(p_name) AS n, p_size AS s, min(p_partkey) AS id FROM part WHERE p_partkey % 4 = 0 GROUP BY 1, 2), w AS (SELECT p_partkey, upper(p_name) AS name, p_size FROM part WHERE p_partkey % 4 <> 0)
SELECT 'found' AS kind, p_partkey, id, NULL AS name FROM w LEFT JOIN e ON e.n = lower(w.name) AND e.s = w.p_size
UNION ALL SELECT 'insert', NULL, p_size, n FROM (SELECT DISTINCT lower(name) AS n, p_size FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.n = lower(w.name) AND e.s = w.p_size))
""")
def get_or_create(spark, sf):
    """J-19: rows with the key of the first one equal on the natural key, and the keys that need an insert."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    existing = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    wanted = part.where("p_partkey % 4 <> 0").select("p_partkey", F.upper("p_name").alias("name"), "p_size")
    found, new = match.get_or_create(wanted, existing, [F.lower("name"), F.col("p_size")], "id")
    none = F.lit(None)
    rows = found.select(F.lit("found").alias("kind"), "p_partkey", "id", none.cast("string").alias("name"))
    return rows.unionByName(new.select(F.lit("insert").alias("kind"), none.cast("long").alias("p_partkey"), F.col("__n1").cast("long").alias("id"), F.col("__n0").alias("name")))


@query("""
SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'except', count(*) FROM (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 25)
UNION ALL SELECT 'all', count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')
""")
def set_operators(spark, sf):
    """X-1, X-3, X-4, X-5: distinct unions, differences and concatenations of key sets."""
    lines = table(spark, sf, "lineitem")
    a, r = (lines.where(F.col("l_returnflag") == x).select("l_partkey") for x in "AR")
    left, right = lines.where("l_returnflag = 'A'").select("l_suppkey", "l_linenumber"), lines.where("l_quantity > 25").select("l_suppkey", "l_linenumber")
    counted = [(match.union_distinct(a, r), "union"), (match.except_distinct(left, right), "except"), (match.union_all(a, r), "all")]
    out = None
    for frame, op in counted:
        row = frame.agg(F.count("*").alias("n")).withColumn("op", F.lit(op))
        out = row if out is None else match.union_all(out, row)
    return out


@query("""
WITH s AS (SELECT DISTINCT n_regionkey AS target_id, title FROM (SELECT n_regionkey, n_name AS title FROM nation UNION ALL SELECT n_regionkey, ' ' FROM nation UNION ALL SELECT n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE trim(title) <> '')
SELECT * FROM s EXCEPT (SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 9)
""")
def alias_transfer(spark, sf):
    """X-6: titles that become aliases of a target: not blank, not its own title, no alias yet."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    own = region.select(F.col("r_regionkey").alias("target_id"), F.col("r_name").alias("title"))
    titles = nation.select(F.col("n_regionkey").alias("target_id"), F.col("n_name").alias("title"))
    source = titles.unionByName(titles.withColumn("title", F.lit(" "))).unionByName(own)
    existing = nation.where("n_nationkey < 9").select(F.col("n_regionkey").alias("target_id"), F.col("n_name").alias("title"))
    return match.alias_transfer(source, own, existing)


@query("""
SELECT l_orderkey, string_agg(CASE WHEN up THEN 'u' ELSE 'o' END || l_linenumber, ',' ORDER BY up, l_linenumber) AS items, list_aggregate(list_sort(list(DISTINCT l_suppkey)), 'string_agg', ',') AS suppliers
FROM (SELECT *, l_returnflag = 'R' AS up FROM lineitem) GROUP BY 1
""")
def grouped_lists(spark, sf):
    """A-2, A-3: a group's rows with unflagged ones first, and the distinct values of its nested arrays."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("up"), "l_linenumber", "l_suppkey")
    groups = match.group_sorted(lines, ["l_orderkey"], "up", ["l_linenumber"])
    items = F.array_join(F.transform("items", lambda x: F.concat(F.when(x["up"], "u").otherwise("o"), x["l_linenumber"])), ",")
    nested = lines.groupBy("l_orderkey", "up").agg(F.collect_list(F.struct("l_suppkey")).alias("parts"))
    flat = match.flatten_distinct(nested, ["l_orderkey"], "parts", "l_suppkey")
    return groups.select("l_orderkey", items.alias("items")).join(flat.select("l_orderkey", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("suppliers")), "l_orderkey")


_PARTS = "SELECT l_orderkey, CAST(l_partkey % 5 AS INT) AS b, CAST(l_linenumber AS INT) AS k FROM lineitem"


@query(f"""
WITH p AS (SELECT DISTINCT * FROM ({_PARTS})),
f AS (SELECT *, lag(k) OVER w AS before, count(*) OVER (PARTITION BY l_orderkey, b) AS m FROM p WINDOW w AS (PARTITION BY l_orderkey, b ORDER BY k)),
ok AS (SELECT *, CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END AS good FROM f)
SELECT l_orderkey, b, bool_and(good) AND max(m) >= 2 AS consecutive FROM ok GROUP BY 1, 2
""")
def strictly_consecutive(spark, sf):
    """W-2: whether all of a group's parts are consecutive."""
    k = F.col("l_linenumber").cast("int")
    base = (F.col("l_partkey") % 5).cast("int")
    parts = table(spark, sf, "lineitem").select("l_orderkey", base.alias("b"), F.concat_ws(".", base.cast("string"), k.cast("string")).alias("number"), base.cast("string").alias("base")).distinct()
    return sequence.strictly_consecutive(parts, ["l_orderkey", "b"], "number", "base")


@query(f"""
WITH p AS (SELECT DISTINCT * FROM ({_PARTS})), t AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey) AS top FROM p),
f AS (SELECT *, lag(k) OVER (PARTITION BY l_orderkey, b ORDER BY k) AS before FROM t WHERE b < top),
ok AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY l_orderkey, b ORDER BY k) AS kept FROM f),
g AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY l_orderkey, b) AS parts FROM ok)
SELECT l_orderkey, b, k, parts FROM g WHERE kept AND parts > 1
""")
def new_part_groups(spark, sf):
    """W-3, W-4, W-1: parts to merge: by base number, without the latest, consecutive from the start, two at least."""
    k, base = F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 5).cast("int")
    parts = table(spark, sf, "lineitem").select("l_orderkey", base.alias("b"), k.alias("k"), F.concat_ws(".", base.cast("string"), k.cast("string")).alias("number")).distinct()
    return sequence.new_part_groups(parts, ["l_orderkey"], "number").select("l_orderkey", "b", "k", "parts")


@query(f"""
WITH p AS (SELECT l_orderkey, b, k, min(k % 2) AS fresh FROM ({_PARTS}) GROUP BY 1, 2, 3), h AS (SELECT DISTINCT l_orderkey, b FROM p WHERE fresh = 0),
f AS (SELECT p.*, lag(k) OVER (PARTITION BY l_orderkey, b ORDER BY k) AS before, count(*) OVER (PARTITION BY l_orderkey, b) AS m FROM p JOIN h USING (l_orderkey, b)),
ok AS (SELECT *, bool_and(CASE WHEN before IS NULL THEN k <= 1 WHEN before = 0 THEN k IN (1, 2) ELSE k = before + 1 END) OVER (PARTITION BY l_orderkey, b ORDER BY k) AS kept FROM f)
SELECT l_orderkey, b, k FROM ok WHERE kept AND m >= 2 AND fresh = 1
""")
def part_additions(spark, sf):
    """W-5: odd parts that continue the even ones, merged before, without a gap."""
    k, base = F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 5).cast("int")
    parts = table(spark, sf, "lineitem").select("l_orderkey", base.cast("string").alias("base"), base.alias("b"), k.alias("k"), F.concat_ws(".", base.cast("string"), k.cast("string")).alias("number")).distinct()
    merged = parts.where("k % 2 = 0").select("l_orderkey", "base", "number")
    return sequence.part_additions(parts.where("k % 2 = 1").drop("base"), merged, ["l_orderkey"], "number").select("l_orderkey", "b", "k")


@query("""
WITH s AS (SELECT l_orderkey AS k, CAST(l_linenumber * 10 AS VARCHAR) AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
w AS (SELECT o_orderkey AS k, CAST(o_orderkey % 40 AS BIGINT) AS at FROM orders)
SELECT w.k, w.at, coalesce(a.name, b.name) AS found FROM w LEFT JOIN s a ON a.k = w.k AND a.i = w.at LEFT JOIN s b ON b.k = w.k AND CAST(b.name AS BIGINT) = w.at
""")
def positional_lookup(spark, sf):
    """W-12: the name at a position in natural order, else the one that is that number."""
    names = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).cast("string").alias("name")).distinct()
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 40).cast("long").alias("at"))
    return sequence.positional_lookup(names, wanted, ["k"], [text.natural_key_strict(F.col("name"))], "name", "at").select("k", "at", "found")


@query("""
WITH q AS (SELECT o_orderkey AS position, o_custkey % 10 AS series, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F'),
a AS (SELECT coalesce(min(position) FILTER (series = 3 AND price > 200000), max(position) + 1, 1) AS spot FROM q)
SELECT position, CASE WHEN position >= spot THEN position + 1 ELSE position END AS shifted, CAST(spot AS BIGINT) AS insert_at FROM q, a
""")
def ordered_insert(spark, sf):
    """W-13: where a new row goes in a queue, and where the others move."""
    queue = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("position"), (F.col("o_custkey") % 10).alias("series"), F.col("o_totalprice").alias("price"))
    return sequence.ordered_insert(queue, "series", "position", "price", F.lit(3), F.lit(200000.0)).select("position", "shifted", "insert_at")


_NATURAL = ["v2.0.1", "1.5", "12.5", "5.cbz", "10.cbz", "a", "A", "", "Chapter 2", "chapter 10", "2", "x9", "9x", "x10", "01", "1"]


@query("""
WITH n AS (SELECT unnest(['v2.0.1', '1.5', '12.5', '5.cbz', '10.cbz', 'a', 'A', '', 'Chapter 2', 'chapter 10', '2', 'x9', '9x', 'x10', '01', '1']) AS name),
t AS (SELECT name, regexp_extract_all(name, '(\\d+?\\.?\\d*)|(\\D+?\\.?\\D*)') AS k FROM n),
p AS (SELECT a.name AS a, b.name AS b, a.k AS x, b.k AS y, unnest(range(1, least(len(a.k), len(b.k)) + 2)) AS i FROM t a, t b),
c AS (SELECT a, b, i, x[i] AS u, y[i] AS v, len(x) AS m, len(y) AS n FROM p),
d AS (SELECT *, CASE WHEN u IS NULL OR v IS NULL THEN sign(m - n) WHEN TRY_CAST(u AS DOUBLE) IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST(u AS DOUBLE) < TRY_CAST(v AS DOUBLE) THEN -1 WHEN TRY_CAST(u AS DOUBLE) > TRY_CAST(v AS DOUBLE) THEN 1 ELSE 0 END
  WHEN upper(u) < upper(v) THEN -1 WHEN upper(u) > upper(v) THEN 1 ELSE 0 END AS o FROM c)
SELECT a, b, CAST(coalesce(arg_min(o, i) FILTER (o <> 0), 0) AS INT) AS compared FROM d GROUP BY a, b
""".replace("\\\\", "\\"))
def natural_compare(spark, sf):
    """S-2: the mixed natural order on names that show each of its rules, every pair of them."""
    names = spark.createDataFrame([(n,) for n in _NATURAL], "name string")
    pairs = names.select(F.col("name").alias("a"), F.explode(F.array(*(F.lit(n) for n in _NATURAL))).alias("b"))
    return pairs.select("a", "b", text.natural_compare(F.col("a"), F.col("b")).alias("compared"))


@query("""
SELECT l_suppkey, string_agg(name, ';' ORDER BY n, ext) AS names FROM (SELECT DISTINCT l_suppkey, 'p' || l_linenumber || e AS name, l_linenumber AS n, e AS ext FROM lineitem, (SELECT unnest(['a', 'b']) AS e)) GROUP BY 1
""")
def natural_lists(spark, sf):
    """S-2, A-2: each group's names in natural order, by comparing pairs."""
    names = table(spark, sf, "lineitem").select("l_suppkey", F.explode(F.array(*(F.concat(F.lit("p"), F.col("l_linenumber"), F.lit(e)) for e in "ba"))).alias("name")).distinct()
    grouped = names.groupBy("l_suppkey").agg(F.collect_list(F.struct("name")).alias("items"))
    return grouped.select("l_suppkey", F.array_join(F.transform(text.natural_sorted(F.col("items"), "name"), lambda x: x["name"]), ";").alias("names"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 30 + (o_orderkey % 10) / 10.0, 'Chapter ' || o_orderkey % 30 || '.' || o_orderkey % 10, o_orderkey) AS rank FROM orders
""")
def chapter_order(spark, sf):
    """S-4: chapters inside their series by decimal number, then natural order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("Chapter "), k % 30, F.lit("."), k % 10).alias("title"))
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(text.chapter_key(F.col("title")), "o_orderkey")).cast("long").alias("rank"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_custkey % 4 = 1 THEN c_nationkey || '.' || c_custkey % 7 WHEN c_custkey % 4 = 2 THEN CAST(c_custkey AS VARCHAR) END AS number,
  CASE WHEN c_custkey % 4 = 1 AND c_nationkey <> 3 THEN CASE WHEN c_custkey % 7 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_nationkey || '.' || c_custkey % 7 END WHEN c_custkey % 4 = 1 AND c_custkey % 7 > 0 THEN c_nationkey || '.' || c_custkey % 7 ELSE '3' END AS corrected,
  CASE WHEN c_custkey % 4 = 1 THEN 'Chapter B Title' ELSE 'No number 7' END AS merged, CASE WHEN c_custkey % 4 = 2 THEN 'Ch.B.cbz' ELSE 'x5.cbz' END AS merged_file FROM customer
""")
def resolved_numbers(spark, sf):
    """F-2, F-4, F-5: a number from metadata, title or file name; its correction by the title; names of the merged chapter."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    title = F.when(k % 4 == 1, F.concat(F.lit("Chapter "), n, F.lit("."), k % 7, F.lit(" Title"))).otherwise("No number 7")
    file = F.when(k % 4 == 2, F.concat(F.lit("Ch."), k, F.lit(".cbz"))).otherwise("x5.cbz")
    given = F.when(k % 4 == 0, n.cast("string")).otherwise("")
    rows = table(spark, sf, "customer").select("c_custkey", title.alias("title"), file.alias("file"), given.alias("given"))
    return rows.select(
        "c_custkey", text.resolve_number(F.col("given"), F.col("title"), F.col("file")).alias("number"), text.corrected_number(F.lit("3"), F.col("title")).alias("corrected"),
        text.merged_title(F.col("title"), F.lit("B")).alias("merged"), text.merged_file_name(F.col("file"), F.lit("B")).alias("merged_file"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a<' ELSE 'a<>z' END AS prefix, CASE WHEN p_size % 2 = 0 THEN '&amp;' || p_size ELSE '' END AS changed, CASE WHEN p_size % 2 = 0 THEN '&gt;z' ELSE '' END AS suffix FROM part
""")
def string_diffs(spark, sf):
    """F-8: what changed between two names, with what stands before and after, made safe for HTML."""
    size = F.col("p_size")
    new = F.when(size % 2 == 0, F.concat(F.lit("a<&"), size, F.lit(">z"))).otherwise("a<>z")
    rows = table(spark, sf, "part").select("p_partkey", text.string_diff(F.lit("a<>z"), new).alias("d"))
    return rows.select("p_partkey", F.col("d.prefix").alias("prefix"), text.html_encode(F.col("d.changed")).alias("changed"), text.html_encode(F.col("d.suffix")).alias("suffix"))


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS y, l_returnflag = 'R' AS fresh, l_quantity AS confidence, l_partkey AS tie FROM lineitem),
u AS (SELECT k, y, arg_min(confidence, (fresh, confidence, tie)) AS c FROM s GROUP BY k, y),
m AS (SELECT k, max(tie) FILTER (NOT fresh) AS old, max(tie) FILTER (fresh) AS new FROM s GROUP BY k)
SELECT k, coalesce(nullif(new, 0), old) AS height, CAST(count(y) AS BIGINT) AS n, string_agg(y || ':' || CAST(c AS BIGINT), ',' ORDER BY y) AS splits FROM m JOIN u USING (k) GROUP BY 1, 2
""")
def merged_splits(spark, sf):
    """F-22, A-9: an earlier and a new detection merged: fields of the new one first, splits by place, the earlier kept."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("y"), (F.col("l_returnflag") == "R").alias("fresh"), F.col("l_quantity").alias("confidence"), F.col("l_partkey").alias("tie"))
    cut = lines.groupBy("k", "fresh").agg(F.max("tie").alias("height"), F.array_sort(F.collect_list(F.struct("y", "confidence", "tie"))).alias("splits"))
    old, new = (cut.where(F.col("fresh") == f).drop("fresh") for f in (False, True))
    merged = match.merge_splits(old, new, "k", ["height"], "splits", "y")
    told = F.array_join(F.transform("splits", lambda s: F.concat_ws(":", s["y"].cast("string"), s["confidence"].cast("long").cast("string"))), ",")
    return merged.select("k", "height", F.size("splits").cast("long").alias("n"), told.alias("splits"))


@query("""
WITH m AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END * cos((2 * i + 1) * k * pi() / 128) AS w FROM range(8) a(k), range(64) b(i)),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
u AS (SELECT vec_id, k, sum(w * x) AS u, sum(w * (x * (i + 1) + 0.25)) AS v FROM e JOIN m USING (i) GROUP BY 1, 2),
c AS (SELECT a.vec_id, a.k AS h, b.k AS g, a.u * b.v AS c FROM u a JOIN u b USING (vec_id)),
o AS (SELECT vec_id, (list_sort(list(c))[32] + list_sort(list(c))[33]) / 2 AS median FROM c GROUP BY 1)
SELECT vec_id, string_agg(CASE WHEN c > median THEN '1' ELSE '0' END, '' ORDER BY h, g) AS bits FROM c JOIN o USING (vec_id) GROUP BY 1
""")
def phash_of_64x64(spark, sf):
    """F-10: perceptual hashes of 64×64 images (outer products of a vector with itself, one side weighted)."""
    e = F.col("embedding")
    weighted = F.transform(e, lambda x, j: x.cast("double") * (j + 1) + 0.25)
    # rows of the image run over the weighted side, columns over the vector
    pixels = F.flatten(F.transform(weighted, lambda y: F.transform(e, lambda x: x.cast("double") * y)))
    # the generator keeps both selections apart: a UDF does not take lambdas in its arguments
    drawn = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(pixels)).alias("pixels"))
    hashed = drawn.select("vec_id", images.phash_udf("pixels").alias("h"))
    return hashed.select("vec_id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


@query("""
SELECT doc_id, toxic, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS r FROM labels) WHERE r = 1
""")
def latest_version(spark, sf):
    """W-10: the values of each key's last version."""
    return sequence.latest_per_key(table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], ["toxic", "quality"])


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal < 0")
def open_counts(spark, sf):
    """J-12, FLT-2: customers with their number of open orders, none as 0."""
    rows = tables.where_all(table(spark, sf, "customer"), None, F.col("c_acctbal") < 0).select("c_custkey")
    return match.with_counts(rows, table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"), "c_custkey", "o_custkey")
