"""Matching, reconciliation and set operators (J-1..J-20, X-1..X-6, A-2, A-3, A-9, A-12): equi-joins with explicit ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import hamming
from ..functions.text import canonical_path


def with_parents(rows: DataFrame, parents: list[tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """J-1: N:1 parents (frame, own key, parent key, required); required ones join inner, others left."""
    for parent, own, key, required in parents:
        rows = rows.join(parent.withColumnRenamed(key, own), own, "inner" if required else "left")
    return rows


def with_children(rows: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """J-2: sibling collections as sorted arrays of structs, one aggregate per child: no child multiplies another."""
    for name, (child, child_key, columns) in children.items():
        gathered = child.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        rows = rows.join(gathered, key, "left")
    return rows


def title_map(primary: DataFrame, alias: DataFrame, key: str, title: str) -> DataFrame:
    """J-3: (title, key, is_alias) of primary titles and aliases; a title's primary owner comes first."""
    return primary.select(F.col(title).alias("title"), key, F.lit(False).alias("is_alias")).unionByName(alias.select(F.col(title).alias("title"), key, F.lit(True).alias("is_alias")))


def resolve_by_title(rows: DataFrame, titles: DataFrame, title: str, key: str) -> DataFrame:
    """J-3: rows with the key their title or an alias names; primary titles win, then the smallest key."""
    best = titles.groupBy("title").agg(F.min_by(key, F.struct("is_alias", key)).alias(key))
    return rows.join(best.withColumnRenamed("title", title), title, "left")


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """J-4: semi-join by id list."""
    return rows.join(ids.select(key), key, "left_semi")


def json_lookup(tasks: DataFrame, data: str, kind: str | None = None, ids: DataFrame | None = None, field: str = "ChapterId") -> DataFrame:
    """J-5, J-6: tasks of a payload type whose JSON id is in a list; the id is added as ``json_id``."""
    found = tasks.withColumn("json_id", F.get_json_object(data, f"$.{field}").try_cast("long"))
    if kind is not None:
        found = found.where(F.get_json_object(data, "$.$type") == kind)
    return found if ids is None else found.join(ids.select(F.col(ids.columns[0]).cast("long").alias("json_id")).distinct(), "json_id", "left_semi")


def json_ids(array: Column) -> Column:
    """J-6: one row per number of a JSON array."""
    return F.explode(F.from_json(array, "array<long>"))


def split_conflicts(groups: DataFrame, merged: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """J-7: (valid, conflicting): groups whose keys are not, and are, merged already."""
    seen = merged.select(*keys).distinct()
    return groups.join(seen, keys, "left_anti"), groups.join(seen, keys, "left_semi")


def reconcile_orphans(files: DataFrame, chapters: DataFrame, path: str, upscaled: str) -> DataFrame:
    """J-8, J-9: per canonical path, both variants of files beside the chapter row, and what to do.

    Outcomes: create, mark_upscaled, none, ignored (an upscaled file without original or chapter).
    """
    sides = files.withColumn("canonical", canonical_path(F.col(path)))
    paired = pair_variants(sides, ["canonical"], upscaled, path)
    known = chapters.select(canonical_path(F.col(path)).alias("canonical"), F.col("is_upscaled")).dropDuplicates(["canonical"]).withColumn("__known", F.lit(True))
    joined = paired.join(known, "canonical", "left")
    action = (
        F.when(F.col("__known").isNull() & F.col("original").isNull(), "ignored")
        .when(F.col("__known").isNull(), "create")
        .when(F.col("variant").isNotNull() & ~F.coalesce("is_upscaled", F.lit(False)), "mark_upscaled")
        .otherwise("none")
    )
    return joined.withColumn("action", action).drop("__known")


def pair_variants(rows: DataFrame, keys: list[str], is_variant: str, value: str) -> DataFrame:
    """J-9: original and variant of each key; of several the largest value wins, whatever the order of reading."""
    return rows.groupBy(*keys).agg(F.max(F.when(~F.col(is_variant), F.col(value))).alias("original"), F.max(F.when(F.col(is_variant), F.col(value))).alias("variant"))


def with_fallback(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, fallback: Column) -> DataFrame:
    """J-10: a looked-up value or what would be computed."""
    return rows.join(lookup.select(*keys, F.col(value).alias("__v")), keys, "left").withColumn(value, F.coalesce("__v", fallback)).drop("__v")


def first_match(rows: DataFrame, others: DataFrame, keys: list[str], order: list[Column], ignore_case: bool = False) -> DataFrame:
    """J-11, J-15: rows with the first of the others that shares their keys, by an explicit order."""
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: F.col(c))
    ranked = others.withColumns({f"__k{i}": norm(k) for i, k in enumerate(keys)})
    marks = [f"__k{i}" for i in range(len(keys))]
    first = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(*marks).orderBy(*order))).where("__r = 1").drop("__r", *keys)
    mine = rows.withColumns({f"__k{i}": norm(k) for i, k in enumerate(keys)})
    return mine.join(first, marks, "left").drop(*marks)


def with_counts(rows: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n") -> DataFrame:
    """A-1, J-12: rows with the number of their children, 0 for none."""
    counted = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return rows.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def match_filters(images: DataFrame, filters: DataFrame, least_similarity: float = 98.5) -> DataFrame:
    """J-13: the filter each image matches: equal MD5 first, else a near perceptual hash; the first filter in order wins.

    ``images``: image_id, content_hash, phash; ``filters``: filter_id, ord, content_hash, phash. With a threshold that
    only equal hashes reach, both passes are equi-joins. Otherwise a near pair agrees in one of d + 1 bands of the hash,
    so bands are the join keys and the distance is checked after; no pair is lost and no cross product is made.
    """
    exact = images.join(filters.select("filter_id", "ord", "content_hash"), "content_hash").select("image_id", "filter_id", F.lit(0).alias("pass"), "ord")
    distance = int((100 - least_similarity) * 64 / 100)
    left = images.join(exact.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.col("phash").alias("p")).where("p is not null")
    right = filters.select("filter_id", "ord", F.col("phash").alias("q")).where("q is not null")
    if distance == 0:
        near = left.join(right, F.col("p") == F.col("q"))
    else:
        near = left.withColumn("band", F.explode(hash_bands(F.col("p"), distance))).join(right.withColumn("band", F.explode(hash_bands(F.col("q"), distance))), "band")
        near = near.where(hamming(F.col("p"), F.col("q")) <= distance)
    near = near.select("image_id", "filter_id", F.lit(1).alias("pass"), "ord")
    return exact.unionByName(near).groupBy("image_id").agg(F.min(F.struct("pass", "ord", "filter_id")).alias("m")).select("image_id", F.col("m.filter_id").alias("filter_id"), (F.col("m.pass") == 0).alias("is_exact"))


def hash_bands(value: Column, distance: int) -> Column:
    """Join keys of a 64-bit hash: hashes within the distance share one at least.

    Of distance + 1 disjoint bands they share one whole. Where these would be short (under eight bits), distance + 2
    bands are cut instead, of which they share two, and every pair of bands is a key.
    """
    pairs = 8 <= distance < 62
    bands = min(distance + (2 if pairs else 1), 64)
    edges = [64 * i // bands for i in range(bands + 1)]
    cut = [F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not pairs:
        return F.array(*(F.struct(F.lit(i).alias("i"), bits.alias("bits")) for i, bits in enumerate(cut)))
    width = max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
    return F.array(*(F.struct(F.lit(i * bands + j).alias("i"), F.shiftleft(cut[i], width).bitwiseOR(cut[j]).alias("bits")) for i in range(bands) for j in range(i + 1, bands)))


def part_pages(page: Column) -> Column:
    """J-14: a page's name without its ``_partN`` suffix, in lower case: the equi-join form of the prefix match."""
    return F.regexp_replace(F.lower(page), r"_part\d*.*$", "")


def title_clashes(rows: DataFrame, title: str, key: str) -> DataFrame:
    """J-16: rows whose title another row has too."""
    owners = rows.groupBy(title).agg(F.min(key).alias("__a"), F.max(key).alias("__b")).where("__a <> __b").select(title)
    return rows.join(owners, title, "left_semi")


def valid_keys(requests: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """J-17, FLT-17: requests whose key is active and not past its expiry (none: valid for ever)."""
    return requests.join(keys.where("active"), "key").where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def match_originals(upscaled: DataFrame, originals: DataFrame, file_name: str, escaped: str, title: str) -> DataFrame:
    """J-18: the original of each upscaled file: its file name or escaped file name, else the first with its title.

    Originals are brought to the first of each name and of each title before they are joined, so a file meets three rows
    at most, however many originals share its name or title.
    """
    first = lambda key: originals.groupBy(F.col(key).alias("__k")).agg(F.min("chapter_id").alias("chapter_id"))
    name = first(file_name)
    passes = [(file_name, name, 0), (escaped, name, 0), (title, first(title), 1)]
    found = None
    for own, other, rank in passes:
        hit = upscaled.select("upscaled_id", F.col(own).alias("__k")).join(other, "__k").select("upscaled_id", F.struct(F.lit(rank).alias("rank"), "chapter_id").alias("m"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("upscaled_id").agg(F.min("m").alias("m")).select("upscaled_id", F.col("m.chapter_id").alias("chapter_id"))
    return upscaled.join(best, "upscaled_id", "left")


def get_or_create(wanted: DataFrame, existing: DataFrame, natural: list[Column], key: str) -> tuple[DataFrame, DataFrame]:
    """J-19: (wanted rows with the key of the first equal row, distinct natural keys that need an insert)."""
    marks = [f"__n{i}" for i in range(len(natural))]
    tag = dict(zip(marks, natural, strict=True))
    known = existing.withColumns(tag).groupBy(*marks).agg(F.min(key).alias(key))
    found = wanted.withColumns(tag).join(known, marks, "left")
    return found.drop(*marks), found.where(F.col(key).isNull()).select(*marks).distinct()


def coverage(expected: DataFrame, present: DataFrame, keys: list[str], part: str) -> DataFrame:
    """J-20: none, partial or complete: how many of the expected parts are present."""
    there = present.select(*keys, part).distinct().withColumn("__there", F.lit(1))
    n = expected.join(there, [*keys, part], "left").groupBy(*keys).agg(F.count("*").alias("expected"), F.count("__there").alias("present"))
    return n.withColumn("coverage", F.when(F.col("present") == 0, "none").when(F.col("present") == F.col("expected"), "complete").otherwise("partial"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """X-1, X-5."""
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """X-3."""
    return a.unionByName(b)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """X-4: case-sensitive set difference."""
    return a.subtract(b)


def set_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """X-2: distinct values on one side only, with the side: missing (left only) or extra (right only); one pass."""
    both = left.select(*keys, value).withColumn("__l", F.lit(1)).unionByName(right.select(*keys, value).withColumn("__l", F.lit(0)))
    seen = both.groupBy(*keys, value).agg(F.max("__l").alias("l"), F.min("__l").alias("r"))
    return seen.where("l = r").select(*keys, value, F.when(F.col("l") == 1, "missing").otherwise("extra").alias("side"))


def sequences_equal(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-12: whether both sides hold the same values the same number of times; ``comparable`` where both have rows."""
    a = left.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("a"))
    b = right.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("b"))
    return a.join(b, keys, "full").select(*keys, F.col("a").eqNullSafe(F.col("b")).alias("equal"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("comparable"))


def alias_transfer(source_titles: DataFrame, target: DataFrame, existing: DataFrame, title: str = "title", key: str = "target_id") -> DataFrame:
    """X-6: titles to add to a target: not blank, not its primary title, not an alias yet."""
    wanted = source_titles.where(F.trim(title) != "").select(key, title).distinct()
    taken = target.select(key, title).unionByName(existing.select(key, title))
    return wanted.join(taken, [key, title], "left_anti")


def merge_splits(old: DataFrame, new: DataFrame, key: str, fields: list[str], splits: str, at: str) -> DataFrame:
    """F-22, A-9: two results of one key as one: fields of the new one where it has them (neither null nor 0), splits of
    both by place, of several at one place the first, earlier result first."""
    names = [*fields, splits]
    sides = [frame.select(key, *(F.col(c).alias(f"{side}_{c}") for c in names)) for frame, side in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], key, "full")
    kind = F.array().cast(old.schema[splits].dataType)
    every = F.concat(F.coalesce(f"old_{splits}", kind), F.coalesce(f"new_{splits}", kind))
    first = F.filter("__all", lambda s, i: F.array_position(F.transform("__all", lambda x: x[at]), s[at]) == i + 1)
    kept = both.withColumn("__all", every).withColumn(splits, F.array_sort(first, lambda x, y: F.when(x[at] < y[at], -1).when(x[at] > y[at], 1).otherwise(0)))
    return kept.select(key, *(F.coalesce(F.nullif(F.col(f"new_{f}"), F.lit(0)), F.col(f"old_{f}")).alias(f) for f in fields), splits)


def group_sorted(rows: DataFrame, keys: list[str], flag: str, columns: list[str]) -> DataFrame:
    """A-2: per key the rows as an array, unflagged first, then by their columns."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(flag, *columns))).alias("items"))


def flatten_distinct(rows: DataFrame, keys: list[str], array: str, value: str) -> DataFrame:
    """A-3: per key the distinct values of nested arrays, sorted."""
    return rows.select(*keys, F.explode(array).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(f"x.{value}") if value else F.col("x"))).alias("values"))


def dedupe_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A-9: the first row of each key by an explicit order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
