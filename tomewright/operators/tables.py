"""Filters, projections, sorts, paging, aggregates and snapshot mutations over tables (FLT-*, PRJ-*, S-*, SNK-1..SNK-6, SNK-10, A-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignore_case
from ..schemas import LOG_LEVELS


def where_all(rows: DataFrame, *optional: Column | None) -> DataFrame:
    """FLT-1, FLT-2: filters composed at run time; None does not filter."""
    return reduce(lambda df, c: df if c is None else df.where(c), optional, rows)


def title_search(rows: DataFrame, aliases: DataFrame | None, needle: str | None, title: str, key: str, alias_key: str = "manga_id", alias_title: str = "title") -> DataFrame:
    """FLT-3: rows whose title or any alias holds the needle, in any case."""
    if not needle or not needle.strip():
        return rows
    own = contains_ignore_case(F.col(title), needle)
    if aliases is None:
        return rows.where(own)
    by_alias = aliases.where(contains_ignore_case(F.col(alias_title), needle)).select(F.col(alias_key).alias(key)).distinct().withColumn("__alias", F.lit(True))
    return rows.join(by_alias, key, "left").where(own | F.coalesce("__alias", F.lit(False))).drop("__alias")


def not_deleted(rows: DataFrame, bypass: bool = False) -> DataFrame:
    """FLT-5: the soft-delete filter and its bypass."""
    return rows if bypass else rows.where(~F.col("deleted"))


def at_least_level(rows: DataFrame, level: str, column: str = "level", levels: list[str] | None = None) -> DataFrame:
    """FLT-6: rows of a severity from ``level`` on."""
    levels = levels or LOG_LEVELS
    return rows.where(F.col(column).isin(levels[levels.index(level) :]))


def ingest_gate(upscale_on_ingest: Column, should_upscale: Column, profile: Column) -> Column:
    """FLT-7: the library wants it, the series does not refuse it (null does not), a profile is set."""
    return F.coalesce(upscale_on_ingest, F.lit(False)) & ~should_upscale.eqNullSafe(F.lit(False)) & profile.isNotNull()


def merge_gate(upscale_on_ingest: Column, should_upscale: Column, profile: Column) -> Column:
    """FLT-8: the series' wish, the library's where it has none, and a profile."""
    return F.coalesce(should_upscale, upscale_on_ingest, F.lit(False)) & profile.isNotNull()


def inherited(own: Column, parent: Column) -> Column:
    """FLT-9, PRJ-2: an override or what it overrides."""
    return F.coalesce(own, parent)


def retryable(status: Column, retries: Column, most: Column) -> Column:
    """FLT-10."""
    return (status == "Pending") | ((status == "Failed") & (retries < most))


def is_stale(version: Column, current: Column | int) -> Column:
    """FLT-11: never processed, or by an older version."""
    return version.isNull() | (version < current)


def has_strip(pages: DataFrame, keys: list[str], width: str, height: str, ratio: float = 2.4) -> DataFrame:
    """FLT-12: whether any page is much taller than wide; a page that could not be read counts as one."""
    return pages.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col(height) / F.nullif(F.col(width), F.lit(0)) > ratio, F.lit(True))).alias("has_strip"))


def needs_hash(content_length: Column, value: Column) -> Column:
    """FLT-16."""
    return value.isNull() & (content_length > 0)


def next_task(splits_found: Column, mode: Column, gate: Column, upscaled: Column, processed: Column | None = None) -> Column:
    """FLT-18: what follows split detection: ApplySplits, RepairUpscale, Upscale or nothing."""
    upscale = F.when(upscaled, "RepairUpscale").otherwise("Upscale")
    routed = F.when(splits_found & (mode == "DetectAndApply"), "ApplySplits").when(splits_found & (mode == "DetectOnly") & gate, upscale).when(~splits_found & gate, upscale)
    return routed if processed is None else F.when(processed, routed)


def upscaled_integrity(flagged: Column, has_file: Column, open_task: Column, pages_equal: Column, has_profile: Column, repair_open: Column) -> Column:
    """FLT-19: the outcome of checking an upscaled chapter against its files and open tasks."""
    no_claim = F.when(~flagged & ~has_file, "Ok").when(~flagged & open_task, "MaybeInProgress").when(flagged & ~has_file, "Missing")
    differs = F.when(repair_open, "MaybeInProgress").when(has_profile, "Repair").otherwise("Invalid")
    return F.coalesce(no_claim, F.when(pages_equal, F.when(flagged, "Ok").otherwise("Corrected")).otherwise(differs))


def move_plan(chapters: DataFrame, source: str, can_move: str) -> DataFrame:
    """FLT-20, P-7: per source: move_all, skip (only some may move), or flag_empty (none may, all failed included)."""
    n = chapters.groupBy(source).agg(F.count("*").alias("chapters"), F.count_if(can_move).alias("movable"))
    return n.withColumn("plan", F.when(F.col("movable") == 0, "flag_empty").when(F.col("movable") == F.col("chapters"), "move_all").otherwise("skip"))


def derived_path(root: Column, relative: Column) -> Column:
    """PRJ-1: a path under a root; null where either is."""
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), relative)


def status_rank(status: Column) -> Column:
    """PRJ-3: done first, then processing, pending, others."""
    return F.when(status.isin("Completed", "Canceled", "Failed"), 0).when(status == "Processing", 1).when(status == "Pending", 2).otherwise(3)


def replaced(struct: Column, **fields: Column) -> Column:
    """PRJ-4: a struct with some fields changed."""
    return reduce(lambda s, kv: s.withField(kv[0], kv[1]), fields.items(), struct)


UPSCALE_TASKS = ["UpscaleTask", "RenameUpscaledChaptersSeriesTask", "RepairUpscaleTask", "DetectSplitCandidatesTask", "ApplySplitsTask"]  # Fixed values.


def is_upscale_task(data: Column) -> Column:
    """PRJ-6: whether a task's payload is of the upscale category."""
    return F.coalesce(F.get_json_object(data, "$.$type").isin(UPSCALE_TASKS), F.lit(False))


def sort_and_page(rows: DataFrame, columns: dict[str, Column], label: str, descending: bool, page: int, size: int, tie: str) -> DataFrame:
    """S-1, S-5, S-6, PRJ-5: a page of rows by a sort label; nulls first ascending; the tie column makes it total."""
    key = columns[label]
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col(tie)).offset(page * size).limit(size)


def page_with_total(rows: DataFrame, columns: dict[str, Column], label: str, descending: bool, page: int, size: int, tie: str) -> DataFrame:
    """S-5: :func:`sort_and_page` with the number of all rows beside each row of the page."""
    total = rows.agg(F.count("*").alias("total"))
    return sort_and_page(rows, columns, label, descending, page, size, tie).join(F.broadcast(total))  # one row


def ignore_case_order(column: str) -> list[Column]:
    """S-8: ordinal order that ignores case, exact text as the tie."""
    return [F.upper(column).asc(), F.col(column).asc()]


def by_child_count(rows: DataFrame, children: DataFrame, key: str, child_key: str, descending: bool = True) -> DataFrame:
    """S-7."""
    counted = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("children"))
    joined = rows.join(counted, key, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    return joined.orderBy(F.col("children").desc() if descending else F.col("children").asc(), key)


def any_rows(rows: DataFrame, n: int) -> DataFrame:
    """S-9: some rows, in no order."""
    return rows.limit(n)


def dequeue(queue: DataFrame, position: str, key: str) -> DataFrame:
    """S-10: the first row of a queue."""
    return queue.orderBy(position, key).limit(1)


def front_position(queue: DataFrame, position: str) -> DataFrame:
    """S-11, A-5: the position before all others; -1 in an empty queue."""
    return queue.agg((F.coalesce(F.min(position), F.lit(0)) - 1).alias("front"))


def last_position(queue: DataFrame, position: str) -> DataFrame:
    """A-5: the largest position; 0 in an empty queue."""
    return queue.agg(F.coalesce(F.max(position), F.lit(0)).alias("last"))


def pending_first(status: Column) -> Column:
    """S-12."""
    return F.when(status == "Pending", 0).otherwise(1)


# Snapshots: plain files have no UPDATE, so a mutation maps a snapshot to the next one.


def stamped(rows: DataFrame, now: Column, created: bool = True) -> DataFrame:
    """SNK-1: creation (on insert) and change stamps."""
    marks = {"modified_at": now} | ({"created_at": now} if created else {})
    return rows.withColumns(marks)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """SNK-1: changed rows keep their creation stamp, new ones get it; the last change stamp is now."""
    old = current.select(*keys, F.col("created_at").alias("__created"))
    fresh = changes.join(old, keys, "left").withColumns({"created_at": F.coalesce("__created", now), "modified_at": now}).drop("__created")
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """SNK-2, ST-11: set-based update, without change stamps, as set-based updates leave them."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """SNK-3."""
    return rows.join(ids.select(key), key, "left_anti")


def replace_for_keys(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-4: all rows of the keys that ``new`` has give way to its rows."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_profile(profiles: DataFrame, old_id: int, new_row: DataFrame) -> DataFrame:
    """SNK-5: a new version in, the old one soft-deleted."""
    return profiles.withColumn("deleted", F.col("deleted") | (F.col("id") == old_id)).unionByName(new_row)


def repoint(rows: DataFrame, column: str, mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """SNK-5: foreign keys moved to new versions."""
    moved = mapping.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return rows.join(moved, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def retain_recent(logs: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """SNK-6: rows of the last days before the newest."""
    newest = logs.agg(F.max(ts).alias("__m"))
    return logs.join(F.broadcast(newest)).where(F.col(ts) > F.col("__m") - F.make_interval(days=F.lit(days))).drop("__m")


def since_last_limit(logs: DataFrame, ts: str, tie: str, size: str, most: int) -> DataFrame:
    """SNK-6: the rows since the log was emptied last: whenever it has reached ``most`` bytes it starts over.

    Running sizes are those of a row's hour plus all hours before, so no window runs over the whole log; the hours are
    as many as the retention allows.
    """
    hour = F.date_trunc("hour", F.col(ts))
    hours = logs.groupBy(hour.alias("__hour")).agg(F.sum(size).alias("__bytes"))
    before = F.sum("__bytes").over(Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1))
    starts = hours.select("__hour", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.sum(size).over(Window.partitionBy("__hour").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    placed = logs.withColumn("__hour", hour).join(starts, "__hour").withColumn("__epoch", F.floor((F.col("__start") + within) / most))
    last = placed.agg(F.max("__epoch").alias("__last"))
    return placed.join(F.broadcast(last)).where("__epoch = __last").drop("__hour", "__start", "__epoch", "__last")  # one row


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """SNK-10: parents and every child table without the rows of ``gone``."""
    out = {"": parents.join(gone.select(key), key, "left_anti")}
    for name, (child, child_key) in children.items():
        out[name] = child.join(gone.select(F.col(key).alias(child_key)), child_key, "left_anti")
    return out


def failure_summary(results: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """A-11, A-13, A-14: all or some failed, and the distinct errors, sorted, joined by ``; ``."""
    return results.groupBy(*keys).agg(F.bool_and(F.col(error).isNotNull()).alias("all_failed"), F.bool_or(F.col(error).isNotNull()).alias("any_failed"), F.array_join(F.sort_array(F.collect_set(error)), "; ").alias("errors"))


def match_counters(filters: DataFrame, matches: DataFrame, key: str = "filter_id", ts: str = "ts") -> DataFrame:
    """A-17: stored counters plus new matches, and the time of the last."""
    new = matches.groupBy(key).agg(F.count("*").alias("__n"), F.max(ts).alias("__t"))
    joined = filters.join(new, key, "left")
    return joined.withColumns({"occurrence_count": F.col("occurrence_count") + F.coalesce("__n", F.lit(0)), "last_matched_at": F.coalesce("__t", "last_matched_at")}).drop("__n", "__t")


def three_level_totals(rows: DataFrame, levels: list[str]) -> DataFrame:
    """A-6, A-7: totals of every level by one rollup of a first aggregate."""
    base = rows.groupBy(*levels).agg(F.count("*").alias("__n"))
    return base.rollup(*levels).agg(F.sum("__n").alias("n"), F.grouping_id().alias("level"))


def status_buckets(rows: DataFrame, status: str, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """A-4, A-21: a count per status in one pass."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values]
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *counts)


def order_hash(array: Column) -> Column:
    """A-20: an order-sensitive hash of an array of structs."""
    return F.xxhash64(array)


def most_pixels(pages: DataFrame, keys: list[str], width: str, height: str) -> DataFrame:
    """A-18."""
    return pages.groupBy(*keys).agg(F.max(F.col(width).cast("long") * F.col(height)).alias("pixels"))


def reconcile_split_state(states: DataFrame, findings: DataFrame, parts: DataFrame, current_version: int) -> DataFrame:
    """ST-15, A-10, J-14: what a split state's findings and files say about it, first rule that holds.

    ``states``: chapter_id, status, last_processed_version; ``findings``: chapter_id, page_file_name, detector_version;
    ``parts``: chapter_id, page_file_name of archives that could be read. Adds action and new_version.
    """
    found = findings.groupBy("chapter_id").agg(F.count("*").alias("findings"), F.max("detector_version").alias("newest"))
    named = findings.select("chapter_id", F.lower("page_file_name").alias("p")).distinct()
    files = parts.select("chapter_id", F.lower("page_file_name").alias("f"))
    whole = files.join(named, (files["chapter_id"] == named["chapter_id"]) & (files["f"] == named["p"]), "left_semi").select("chapter_id").distinct().withColumn("whole", F.lit(True))
    cut = files.where(F.col("f").contains("_part")).withColumn("p", F.regexp_replace("f", r"_part.*$", "")).join(named, ["chapter_id", "p"], "left_semi").select("chapter_id").distinct().withColumn("cut", F.lit(True))
    rows = states.join(found, "chapter_id", "left").join(whole, "chapter_id", "left").join(cut, "chapter_id", "left")
    n, version = F.coalesce("findings", F.lit(0)), F.col("last_processed_version")
    status = F.col("status")
    action = (
        F.when((status == "NoSplitsFound") & (n > 0), "set_detected")
        .when((status == "NoSplitsFound") & (version < current_version), "delete_state")
        .when((status == "Detected") & (n == 0), "set_no_splits")
        .when((status == "Applied") & (n == 0) & (version == 0), "set_detected")
        .when((n > 0) & (version == 0) & (status != "Detected"), "set_detected_newest")
        .when((status == "Applied") & (n > 0) & F.col("cut").isNull() & F.col("whole").isNotNull(), "reapply")
        .otherwise("ok")
    )
    return rows.select("chapter_id", "status", n.alias("findings"), action.alias("action"), F.when(action == "set_no_splits", F.lit(current_version)).when(action == "set_detected_newest", F.col("newest")).otherwise(version).alias("new_version"))
