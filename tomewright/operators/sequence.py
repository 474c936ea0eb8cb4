"""Sequence operators over ordered groups (W-1..W-14, A-8): windows where rows are independent, folds where they are not."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DECIMAL, base_number

STEP, TOLERANCE = "0.1", "0.001"  # Fixed values: the distance of parts and how far off they may be.


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(TOLERANCE).cast(DECIMAL)


def sequence_flags(rows: DataFrame, keys: list[str], number: str, base: str) -> DataFrame:
    """W-1's and W-2's shared part: adds n (decimal) and keep: whether a row is in its group's consecutive prefix.

    Rows whose number does not parse are gone. A group needs two rows and no repeated number; it starts at its base or
    one step beyond; after the base one or two steps may follow, later exactly one.
    """
    step = F.lit(STEP).cast(DECIMAL)
    parsed = rows.withColumns({"n": F.col(number).try_cast(DECIMAL), "__base": F.col(base).try_cast(DECIMAL)}).where("n is not null and __base is not null")
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("n")
    before, b = F.lag("n").over(ordered), F.col("__base")
    ok = F.when(before.isNull(), _near(F.col("n"), b) | _near(F.col("n"), b + step)).when(
        _near(before, b), _near(F.col("n"), b + step) | _near(F.col("n"), b + step * 2)
    ).otherwise(_near(F.col("n"), before + step))
    flagged = parsed.withColumns({"__ok": ok.cast("int"), "__repeat": F.coalesce(before == F.col("n"), F.lit(False)).cast("int"), "__m": F.count("*").over(group)})
    kept = (F.min("__ok").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.max("__repeat").over(group) == 0) & (F.col("__m") >= 2)
    return flagged.withColumn("keep", kept).drop("__ok", "__repeat", "__m", "__base")


def consecutive_prefix(rows: DataFrame, keys: list[str], number: str, base: str) -> DataFrame:
    """W-1: the rows of each group's consecutive prefix."""
    return sequence_flags(rows, keys, number, base).where("keep").drop("keep")


def strictly_consecutive(rows: DataFrame, keys: list[str], number: str, base: str) -> DataFrame:
    """W-2: keys with whether the whole group is consecutive."""
    return sequence_flags(rows, keys, number, base).groupBy(*keys).agg(F.bool_and("keep").alias("consecutive"))


def without_latest(rows: DataFrame, keys: list[str], number: str, include_latest: bool = False) -> DataFrame:
    """W-4: rows but those of the largest whole number of their series; the flag bypasses it."""
    if include_latest:
        return rows
    whole = F.floor(F.col(number).try_cast(DECIMAL))
    return rows.withColumn("__top", F.max(whole).over(Window.partitionBy(*keys))).where(whole < F.col("__top")).drop("__top")


def new_part_groups(rows: DataFrame, series: list[str], number: str, include_latest: bool = False) -> DataFrame:
    """W-3: parts to merge: rows by base number, latest dropped, consecutive prefixes of two or more."""
    based = rows.withColumn("base", base_number(F.col(number)))
    eligible = without_latest(based, series, number, include_latest)
    kept = consecutive_prefix(eligible, [*series, "base"], number, "base")
    return kept.withColumn("parts", F.count("*").over(Window.partitionBy(*series, "base"))).where("parts > 1")


def part_additions(candidates: DataFrame, merged_parts: DataFrame, series: list[str], number: str) -> DataFrame:
    """W-5: candidates (one-digit parts of a merged base) that continue the merged parts without a gap.

    ``merged_parts`` has the series' columns, ``base`` and ``number`` of parts that are merged already.
    """
    based = candidates.withColumn("base", base_number(F.col(number))).where(F.col(number).rlike(r"^\d+\.\d$"))
    bases = merged_parts.select(*series, "base").distinct()
    mine = based.join(bases, [*series, "base"], "left_semi").withColumn("__new", F.lit(True))
    old = merged_parts.select(*series, "base", F.col("number").alias(number)).withColumn("__new", F.lit(False))
    joined = mine.unionByName(old, allowMissingColumns=True)
    return consecutive_prefix(joined, [*series, "base"], number, "base").where("__new").drop("__new", "n")


def unnumbered_additions(candidates: DataFrame, accepted: DataFrame, number: str, metadata_number: str) -> DataFrame:
    """W-5's second way in: candidates whose metadata number equals that of an accepted one, the empty one included."""
    return candidates.join(accepted.select(metadata_number).distinct(), metadata_number, "left_semi")


def page_offsets(parts: DataFrame, keys: list[str], order: list[Column], pages: str) -> DataFrame:
    """W-6: first and last page index of each part when parts stand one after another."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(pages).over(before), F.lit(0))
    return parts.withColumns({"start_page": start, "end_page": start + F.col(pages) - 1})


def page_label(index: Column) -> Column:
    """W-6: at least four digits, never fewer than the number has."""
    text = index.cast("string")
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))


def repaired_ranges(parts: Column) -> Column:
    """W-7: an array of (start, end, pages) sorted by start, each fixed against its already fixed predecessor.

    An end before its start is rebuilt from the page count; a start not beyond the last end moves behind it.
    """

    def fixed(done: Column, part: Column) -> Column:
        pages = F.greatest(F.lit(0), part["pages"] - 1)
        end = F.when(part["end"] < part["start"], part["start"] + pages).otherwise(part["end"])
        last = F.try_element_at(done, F.lit(-1))["end"]
        overlaps = F.coalesce(part["start"] <= last, F.lit(False))
        start = F.when(overlaps, last + 1).otherwise(part["start"])
        return F.concat(done, F.array(F.struct(start.alias("start"), F.when(overlaps, start + pages).otherwise(end).alias("end"), part["pages"].alias("pages"))))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,pages:bigint>>")
    typed = F.array_sort(parts.cast("array<struct<start:bigint,end:bigint,pages:bigint>>"))
    return F.aggregate(typed, empty, fixed)


def repair_ranges(parts: DataFrame, key: str) -> DataFrame:
    """W-7 over rows (key, start, end, pages): :func:`repaired_ranges` read as a stream in order of start.

    Only the last end of a key is kept, so a key may have any number of rows.
    """
    picked = parts.select(key, *(F.col(c).cast("long").alias(c) for c in ("start", "end", "pages")))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last = None
        for batch in source:
            starts, ends = [], []
            for name, start, end, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last_key:
                    last_key, last = name, None
                size = max(0, pages - 1)
                if end < start:
                    end = start + size
                if last is not None and start <= last:
                    start, end = last + 1, last + 1 + size
                last = end
                starts.append(start)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), batch.column(3)], names=batch.schema.names)

    return picked.na.drop().repartition(key).sortWithinPartitions(key, "start", "end", "pages").mapInArrow(run, picked.schema)


def crop_segments(cuts: DataFrame, keys: list[str], cut: str, height: str) -> DataFrame:
    """W-8: segments (top, bottom, name suffix) between cuts inside a page; cuts outside or repeated do not count."""
    inner = cuts.where((F.col(cut) > 0) & (F.col(cut) < F.col(height))).select(*keys, height, F.col(cut).cast("long").alias("bottom"))
    ends = cuts.select(*keys, height, F.col(height).cast("long").alias("bottom"))
    edges = inner.union(ends).distinct()
    order = Window.partitionBy(*keys, height).orderBy("bottom")
    return edges.select(*keys, F.lag("bottom", 1, 0).over(order).alias("top"), "bottom", F.concat(F.lit("_part"), F.row_number().over(order)).alias("part"))


def equal_segments(rows: DataFrame, height: str, parts: Column) -> DataFrame:
    """W-9: ``parts`` segments of equal whole height; the last takes the rest."""
    size = F.floor(F.col(height) / parts)
    spread = rows.withColumns({"__parts": parts, "__size": size}).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts").cast("long") - 1)))
    top = F.col("segment") * F.col("__size")
    bottom = F.when(F.col("segment") == F.col("__parts") - 1, F.col(height)).otherwise(top + F.col("__size"))
    return spread.withColumns({"top": top.cast("long"), "bottom": bottom.cast("long")}).drop("__parts", "__size")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """W-10, ST-10: the values of each key's last row; one row per key and task reaches the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*keys, *(F.col(f"__v.{v}").alias(v) for v in values))


def progress_rates(rows: DataFrame, key: str, ts: str, done: str) -> DataFrame:
    """W-11: seconds per page between successive progress rows where both time and pages moved forward."""
    order = Window.partitionBy(key).orderBy(ts, done)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) / 1_000_000
    pages = F.col(done) - F.lag(done).over(order)
    return rows.withColumns({"seconds": seconds, "pages": pages}).where("seconds > 0 and pages > 0").withColumn("seconds_per_page", F.col("seconds") / F.col("pages"))


def positional_lookup(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list[Column], name: str, index: str) -> DataFrame:
    """W-12: the name at a position in natural order, else the row whose name is that number."""
    placed = rows.select(*keys, F.col(name).alias("at_position"), (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long").alias("__i"))
    by_name = rows.select(*keys, F.col(name).alias("by_name"), F.col(name).try_cast("long").alias("__n")).where("__n is not null").dropDuplicates([*keys, "__n"])
    found = wanted.join(placed.withColumnRenamed("__i", index), [*keys, index], "left").join(by_name.withColumnRenamed("__n", index), [*keys, index], "left")
    return found.withColumn("found", F.coalesce("at_position", "by_name")).drop("at_position", "by_name")


def ordered_insert(queue: DataFrame, series: str, position: str, sort_key: str, new_series: Column, new_key: Column) -> DataFrame:
    """W-13: adds ``shifted`` (each row's position after the insert) and ``insert_at`` (the new row's) to a queue.

    The new row goes before the first row of its series that sorts after it, else to the end; rows from there on move by one.
    """
    later = F.min(F.when((F.col(series) == new_series) & (F.col(sort_key) > new_key), F.col(position)))
    at = queue.agg(F.coalesce(later, F.max(position) + 1, F.lit(1)).cast("long").alias("insert_at"))
    moved = F.when(F.col(position) >= F.col("insert_at"), F.col(position) + 1).otherwise(F.col(position))
    return queue.join(F.broadcast(at)).withColumn("shifted", moved)  # the one row of an aggregate without keys


def keep_newest(rows: DataFrame, created: str, n: int = 100) -> DataFrame:
    """W-14: rows newer than the (n+1)-th newest; its ties go with it, so fewer than n may stay."""
    cut = rows.where(F.col(created).isNotNull()).select(created).orderBy(F.desc(created)).limit(n + 1).agg(F.when(F.count("*") > n, F.min(created)).alias("__cut"))
    return rows.join(F.broadcast(cut)).where(F.col("__cut").isNull() | (F.col(created) > F.col("__cut"))).drop("__cut")


def has_repeats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-8: whether a group's values repeat."""
    return rows.groupBy(*keys).agg((F.count_distinct(value) != F.count(value)).alias("repeats"))
