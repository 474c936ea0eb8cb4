"""Composite pipelines (P-1..P-13) as plans: each returns rows that say what to do; a writer applies them.

A plan reads whole tables and decides every row's outcome with joins and windows; nothing is looked up row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_number, canonical_path, corrected_number, escape_directory_name, escape_file_name, is_upscaled_path, merged_file_name, merged_title, resolve_number
from ..operators import match, sequence, tables
from ..operators.rules import Rule, apply_rename_rules, filter_by_rules
from ..session import materialised

Latest = Callable[[DataFrame, DataFrame], DataFrame]


def without_latest_of_all(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """W-4 over all numbers of a series, those that are catalogued too (X-1), not only those at hand: the default for
    the choice of what may be merged; callers may hand :func:`merge_plan` another."""
    whole = F.floor(F.col("number").try_cast(sequence.DECIMAL))
    known = match.union_distinct(rows.select("series", "number"), numbers.select("series", "number"))
    top = known.groupBy("series").agg(F.max(whole).alias("__top"))
    return rows.join(top, "series").where(whole < F.col("__top")).drop("__top")


def merge_plan(chapters: DataFrame, merged_parts: DataFrame, numbers: DataFrame | None = None, eligible: Latest | None = without_latest_of_all) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P-2: (new groups, additions to merges, conflicting groups) of chapters (series, file_name, title, number).

    ``merged_parts`` (series, base, number) are merged already, ``numbers`` (series, number) catalogued. ``eligible``
    decides which chapters may be merged (U-4); None lets all, as a forced merge does. A new group of a base that is
    merged already conflicts. New groups get the merged chapter's names from their first part.
    """
    named = chapters.withColumn("base", base_number(F.col("number")))
    allowed = named if eligible is None else eligible(named, chapters if numbers is None else numbers)
    groups = sequence.consecutive_prefix(allowed, ["series", "base"], "number", "base")
    sized = groups.groupBy("series", "base").agg(F.count("*").alias("parts"), F.min_by(F.struct("file_name", "title"), "n").alias("first")).where("parts > 1")
    made = sized.select("series", "base", "parts", merged_file_name(F.col("first.file_name"), F.col("base")).alias("merged_file"), merged_title(F.col("first.title"), F.col("base")).alias("merged_title"))
    members = groups.drop("n").join(made, ["series", "base"])
    valid, conflicts = match.split_conflicts(members, merged_parts, ["series", "base"])
    additions = sequence.part_additions(chapters, merged_parts, ["series"], "number")
    return valid, additions, conflicts


def merged_pages(parts: DataFrame) -> DataFrame:
    """P-2: page ranges of parts in a merge: merge_id, number, file_name, n_pages; parts in order of their number."""
    return sequence.page_offsets(parts, ["merge_id"], [F.col("number").try_cast(sequence.DECIMAL), F.col("file_name")], "n_pages")


def retroactive_merge_plan(chapters: DataFrame, merged_parts: DataFrame, upscaled_files: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """P-3: catalogued chapters that form a merge now, and what becomes of the merged chapter's upscaled variant.

    ``chapters``: chapter_id, series, file_name, title, number; ``upscaled_files``: chapter_id with an upscaled file;
    ``open_tasks``: chapter_id of open upscale tasks, which the merge removes. A merge of parts that are all upscaled
    is upscaled; of some, the missing ones are upscaled; of none, as usual.
    """
    valid, _, _ = merge_plan(chapters, merged_parts)
    up = upscaled_files.select("chapter_id").distinct().withColumn("__up", F.lit(True))
    tasks = open_tasks.select("chapter_id").distinct().withColumn("__task", F.lit(True))
    rows = valid.join(up, "chapter_id", "left").join(tasks, "chapter_id", "left")
    each = rows.groupBy("series", "base", "merged_file").agg(F.count("*").alias("expected"), F.count("__up").alias("present"), F.count("__task").alias("removed_tasks"), F.sort_array(F.collect_list("chapter_id")).alias("chapter_ids"))
    outcome = F.when(F.col("present") == 0, "none").when(F.col("present") == F.col("expected"), "complete").otherwise("partial")
    return each.withColumn("upscaled", outcome)


def revert_plan(merged: DataFrame, present: DataFrame) -> DataFrame:
    """P-4: what undoing a merge does, a row per part and one for the merged chapter.

    ``merged``: chapter_id, series, is_upscaled, has_file, original_parts; ``present``: file_name of chapters there now.
    Without its file a merge cannot be undone, nor without parts. Parts are cut from its pages by range; one whose
    chapter is there again replaces it; the merged chapter goes once all its parts are back.
    """
    blocked = F.when(~F.col("has_file"), "file_missing").when(F.coalesce(F.size("original_parts"), F.lit(0)) <= 0, "no_parts")
    rows = merged.withColumn("__blocked", blocked)
    parts = rows.where("__blocked is null").select("chapter_id", "series", "is_upscaled", F.explode("original_parts").alias("p")).select(
        "chapter_id", "is_upscaled", F.col("p.file_name").alias("file_name"), F.col("p.start_page_index").alias("start_page"), F.col("p.end_page_index").alias("end_page"),
        F.concat_ws("/", escape_file_name(F.col("series")), F.col("p.file_name")).alias("path"),
    )
    there = present.select("file_name").distinct().withColumn("__there", F.lit(True))
    restored = parts.join(there, "file_name", "left").withColumn("action", F.when(F.col("__there"), "replace").otherwise("restore")).drop("__there")
    whole = rows.select("chapter_id", "is_upscaled", F.coalesce("__blocked", F.lit("remove_merged")).alias("action"))
    return restored.unionByName(whole, allowMissingColumns=True)


def ingest_plan(found: DataFrame, filter_rules: Iterable[Rule], rename_rules: Iterable[Rule], titles: DataFrame, series: DataFrame, existing: DataFrame, merged_parts: DataFrame, upscale_on_ingest: Column, merge_parts: Column, profile: Column) -> DataFrame:
    """P-1: found chapters filtered, renamed, resolved to a series, merged and routed: a row each with its action and next task.

    ``found``: file_name, relative_path, series, chapter_title, number; ``titles``: title, series_id, is_alias;
    ``series``: series_id, should_upscale, merge_chapter_parts; ``existing``: series_id, number of catalogued chapters;
    ``merged_parts``: series_id, base, number; the columns are the library's settings.

    Actions: attach (an upscaled file of an original at hand), unmatched (one without), skip_merged (its number is part
    of a merge), append (continues a merge), merge (part of a new group), add. A series that no title names is created.
    The latest chapter of a series, counting those that are catalogued, is never merged. What is added or merged is
    upscaled where the ingest gate lets it.
    """
    kept = filter_by_rules(found, filter_rules, {"MangaTitle": F.col("series"), "ChapterTitle": F.col("chapter_title"), "FilePath": F.col("relative_path")})
    fixed = kept.withColumn("number", corrected_number(F.col("number"), F.col("chapter_title")))
    renamed = apply_rename_rules(fixed, rename_rules).withColumns({"is_upscaled": is_upscaled_path(F.col("relative_path")), "canonical": canonical_path(F.col("relative_path"))})
    known = match.resolve_by_title(renamed, titles, "series", "series_id").join(series, "series_id", "left")
    # one name for a series' chapters, whichever alias found them
    rows = known.withColumns({"title": F.col("chapter_title"), "name": F.col("series"), "series": F.coalesce(F.concat(F.lit("#"), F.col("series_id")), F.col("series")), "number": resolve_number(F.col("number"), F.col("chapter_title"), F.col("file_name"))})
    rows = materialised(rows, "ingest-rows")
    keyed = lambda frame: frame.select(F.concat(F.lit("#"), F.col("series_id")).alias("series"), *[c for c in frame.columns if c != "series_id"])
    parts = keyed(merged_parts)

    originals = rows.where("not is_upscaled")
    wanted = originals.where(tables.inherited(F.col("merge_chapter_parts"), merge_parts))
    done = parts.select("series", "number").distinct().withColumn("__merged", F.lit(True))
    open_ = wanted.join(done, ["series", "number"], "left_anti")
    numbers = match.union_distinct(keyed(existing).select("series", "number"), rows.select("series", "number"))
    groups, additions, _ = merge_plan(materialised(open_.select("series", "file_name", "title", "number", "canonical"), "ingest-open"), parts, numbers)
    place = ["series", "canonical"]
    grouped = groups.select(*place, F.col("base").alias("__base"), "merged_file").withColumn("__group", F.lit(True))
    appended = additions.select(*place, F.lit(True).alias("__append"))
    hosts = originals.select(*place).distinct().withColumn("__host", F.lit(True))
    met = rows.join(done, ["series", "number"], "left").join(grouped, place, "left").join(appended, place, "left").join(hosts, place, "left")
    plain = ~F.col("is_upscaled")
    action = (
        F.when(F.col("is_upscaled"), F.when(F.col("__host"), "attach").otherwise("unmatched"))
        .when(F.col("__merged") & tables.inherited(F.col("merge_chapter_parts"), merge_parts), "skip_merged")
        .when(F.col("__append"), "append").when(F.col("__group"), "merge").otherwise("add")
    )
    gate = tables.ingest_gate(upscale_on_ingest, F.col("should_upscale"), profile)
    out = met.withColumns({"action": action, "create_series": F.col("series_id").isNull()})
    task = F.when(plain & F.col("action").isin("add", "merge") & gate, "Upscale")
    return out.select("file_name", "relative_path", F.col("name").alias("series"), "series_id", "number", "is_upscaled", "create_series", "action", "merged_file", task.alias("next_task"))


def integrity_plan(chapters: DataFrame, pages: DataFrame, tasks: DataFrame, findings: DataFrame | None = None, states: DataFrame | None = None, current_version: int = 1) -> DataFrame:
    """P-5: every chapter's original check, upscaled check and split state check, and whether anything changes.

    ``chapters``: chapter_id, original_path, upscaled_path, is_upscaled, profile_id; ``pages``: path, page of every
    archive that is there; ``tasks``: chapter_id, kind (Upscale or Repair) of open tasks; ``findings`` and ``states`` as
    :func:`tables.reconcile_split_state` takes them, whose files are the chapters' original pages.

    The upscaled check is skipped where the original is missing. Pages are compared as sets of names: what is missing and
    extra in the upscaled file; a file that differs is repaired where a profile is set.
    """
    there = pages.select("path").distinct()
    sides = {}
    for side in ("original", "upscaled"):
        named = chapters.select("chapter_id", F.col(f"{side}_path").alias("path"))
        sides[side] = named.join(pages, "path").select("chapter_id", "page").distinct()
        chapters = chapters.join(there.select(F.col("path").alias(f"{side}_path"), F.lit(True).alias(f"has_{side}")), f"{side}_path", "left").withColumn(f"has_{side}", F.coalesce(f"has_{side}", F.lit(False)))
    both = match.set_difference(sides["original"], sides["upscaled"], ["chapter_id"], "page")
    counts = both.groupBy("chapter_id").agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))
    opened = tasks.groupBy("chapter_id").agg(F.bool_or(F.col("kind") == "Upscale").alias("__up"), F.bool_or(F.col("kind") == "Repair").alias("__repair"))
    rows = chapters.join(counts, "chapter_id", "left").join(opened, "chapter_id", "left")
    no, none = F.lit(False), F.lit(0).cast("long")
    rows = rows.withColumns({"missing": F.coalesce("missing", none), "extra": F.coalesce("extra", none)})
    equal = (F.col("missing") == 0) & (F.col("extra") == 0)
    outcome = tables.upscaled_integrity(F.col("is_upscaled"), F.col("has_upscaled"), F.coalesce("__up", no), equal, F.col("profile_id").isNotNull(), F.coalesce("__repair", no))
    rows = rows.withColumns({"original_result": F.when(F.col("has_original"), "Ok").otherwise("Missing"), "upscaled_result": F.when(F.col("has_original"), outcome)})
    columns = ["chapter_id", "original_result", "upscaled_result", "missing", "extra"]
    changed = (F.col("original_result") == "Missing") | F.coalesce(F.col("upscaled_result").isin("Missing", "Corrected", "Repair", "Invalid"), no)
    if states is None:
        return rows.select(*columns, changed.alias("changed"))
    parts = sides["original"].select("chapter_id", F.col("page").alias("page_file_name"))
    split = tables.reconcile_split_state(states, findings, parts, current_version).select("chapter_id", F.col("action").alias("split_action"))
    return rows.join(split, "chapter_id", "left").select(*columns, "split_action", (changed | F.coalesce(F.col("split_action") != "ok", no)).alias("changed"))


def orphan_plan(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """P-6."""
    return match.reconcile_orphans(files.withColumn("is_up", is_upscaled_path(F.col("path"))), chapters, "path", "is_up")


def series_merge_plan(chapters: DataFrame) -> DataFrame:
    """P-7: chapters: source, target_path, exists_at_target."""
    return tables.move_plan(chapters.withColumn("can_move", ~F.col("exists_at_target")), "source", "can_move")


def library_move_plan(chapters: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """P-8: chapters (chapter_id, series, file_name, relative_path, has_file) of series that move to another library.

    A series moves with all its chapters: a path that is taken (``existing``: path) or claimed twice blocks the whole series; a
    missing file only keeps its chapter from being moved on disk.
    """
    new = F.concat_ws("/", F.lit(root.rstrip("/")), escape_file_name(F.col("series")), escape_file_name(F.col("file_name")))
    rows = chapters.withColumn("new_path", new)
    claims = rows.groupBy("new_path").agg(F.count("*").alias("__n"))
    taken = existing.select(F.col("path").alias("new_path")).distinct().withColumn("__taken", F.lit(True))
    rows = rows.join(claims, "new_path").join(taken, "new_path", "left").withColumn("__clash", (F.col("__n") > 1) | F.coalesce("__taken", F.lit(False)))
    blocked = rows.groupBy("series").agg(F.bool_or("__clash").alias("__blocked"))
    action = F.when(F.col("__clash"), "conflict").when(F.col("__blocked"), "blocked").when(~F.col("has_file"), "missing").otherwise("move")
    return rows.join(blocked, "series").select("chapter_id", F.col("relative_path").alias("old_path"), "new_path", action.alias("action"))


def series_rename_plan(chapters: DataFrame, titles: DataFrame, renames: DataFrame, existing: DataFrame) -> DataFrame:
    """P-9: chapters (chapter_id, series_id, relative_path, file_name, has_file) of series that get a new title.

    ``titles``: title, series_id (primary ones and aliases); ``renames``: series_id, new_title; ``existing``: path of files.
    A title that another series owns, or a target path that is taken, cancels a series' rename; a missing file skips its
    chapter only. Folders take the directory-safe form of the title.
    """
    owners = titles.select(F.col("title").alias("new_title"), F.col("series_id").alias("__owner")).distinct()
    clash = renames.join(owners, "new_title").where("__owner <> series_id").select("series_id").distinct().withColumn("__clash", F.lit(True))
    new = F.concat_ws("/", escape_directory_name(F.col("new_title")), F.col("file_name"))
    rows = chapters.join(renames, "series_id").withColumn("new_path", new)
    taken = existing.select(F.col("path").alias("new_path")).distinct().withColumn("__taken", F.lit(True))
    rows = rows.join(clash, "series_id", "left").join(taken, "new_path", "left").withColumn("__taken", F.coalesce("__taken", F.lit(False)) & (F.col("new_path") != F.col("relative_path")))
    stop = rows.groupBy("series_id").agg(F.bool_or("__taken").alias("__stop"))
    action = F.when(F.col("__clash"), "title_conflict").when(F.col("__stop"), "path_conflict").when(~F.col("has_file"), "skip_missing").otherwise("rename")
    return rows.join(stop, "series_id").select("chapter_id", F.col("relative_path").alias("old_path"), "new_path", action.alias("action"))


def split_apply_plan(findings: DataFrame, pages: DataFrame, upscaled: DataFrame) -> DataFrame:
    """P-10: what becomes of every page of chapters whose splits are applied, original archive first, then the upscaled one.

    ``findings``: chapter_id, page, cut, height; ``pages`` and ``upscaled``: chapter_id, page (base names, any case). An
    original page with cuts gives its segments, others are copied. An upscaled page whose original was cut gives way to
    that page's segments, upscaled anew; others are copied.
    """
    lowered = lambda frame: frame.withColumn("__p", F.lower("page"))
    segments = sequence.crop_segments(lowered(findings).select("chapter_id", "__p", "cut", "height"), ["chapter_id", "__p"], "cut", "height")
    cut = segments.groupBy("chapter_id", "__p").agg(F.count("*").alias("__n")).where("__n > 1")
    pieces = segments.join(cut, ["chapter_id", "__p"], "left_semi")
    out = None
    for archive, frame, action in (("original", pages, "crop"), ("upscaled", upscaled, "upscale_segment")):
        met = lowered(frame).join(pieces, ["chapter_id", "__p"], "left")
        named = F.concat("page", F.coalesce("part", F.lit("")))
        rows = met.select("chapter_id", F.lit(archive).alias("archive"), "page", named.alias("new_page"), "top", "bottom", F.when(F.col("part").isNotNull(), action).otherwise("copy").alias("action"))
        out = rows if out is None else out.unionByName(rows)
    return out


def image_filter_plan(images: DataFrame, filters: DataFrame, least_similarity: float = 98.5) -> tuple[DataFrame, DataFrame]:
    """P-11: (images to remove with the filter that matched and how, filters with their counters moved on).

    ``images``: image_id, content_hash, phash, ts; ``filters``: filter_id, ord, content_hash, phash, occurrence_count,
    last_matched_at.
    """
    hits = match.match_filters(images, filters, least_similarity)
    counted = tables.match_counters(filters, hits.join(images.select("image_id", "ts"), "image_id"))
    return hits, counted


def repair_plan(originals: DataFrame, upscaled: DataFrame) -> DataFrame:
    """P-13: what becomes of every page name (chapter_id, page) of an upscaled chapter that is repaired.

    Missing pages are upscaled from the original, extra ones dropped, the rest kept; the upscaled ones overlay the kept.
    """
    differing = match.set_difference(originals, upscaled, ["chapter_id"], "page")
    kept = originals.select("chapter_id", "page").distinct().join(upscaled.select("chapter_id", "page"), ["chapter_id", "page"], "left_semi")
    acted = differing.select("chapter_id", "page", F.when(F.col("side") == "missing", "upscale").otherwise("drop").alias("action"))
    return acted.unionByName(kept.withColumn("action", F.lit("keep")))
