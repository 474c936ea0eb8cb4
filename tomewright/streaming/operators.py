"""Stream operators (ST-1..ST-18): each is event-time, so a batch twin over the same rows gives the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, keys: list[str], ts: str, event: str, silence: str = "15 seconds") -> DataFrame:
    """ST-1, ST-2: the last event of each burst, once ``silence`` has passed; the same code for batch and stream.

    A stream needs a watermark on ``ts`` and append mode.
    """
    window = F.session_window(ts, silence)
    return events.groupBy(*keys, window.alias("w")).agg(F.max_by(event, F.struct(ts, event)).alias(event), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("w")


def changed_only(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """ST-2: rows whose value differs from the one before (distinct until changed)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumns({"__b": before, "__f": first}).where(F.col("__f") | ~F.col("__b").eqNullSafe(F.col(value))).drop("__b", "__f")


def throttle(rows: DataFrame, key: str, ts: str, gap_seconds: float = 0.25, tie: str | None = None) -> DataFrame:
    """ST-3, batch twin: the rows a throttle emits: each at least the gap after the last one emitted.

    What is emitted depends on what was, so a key's rows are read in order as a stream; the last emitted time is all that
    is kept, whatever a key's number of rows.
    """
    gap = int(gap_seconds * 1_000_000)
    names = [key, "emitted_at", *([tie] if tie else [])]
    picked = rows.select(F.col(key), F.col(ts).cast("timestamp").alias("emitted_at"), *([F.col(tie)] if tie else []))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in source:
            keys = batch.column(0).to_pylist()
            us = batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            keep, i = [], 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != last_key:
                    last_key, last = keys[i], None
                at = i
                while at < j:  # from one emitted row to the next, by binary search
                    at = at if last is None else i + int(np.searchsorted(us[i:j], last + gap))
                    if at < j:
                        keep.append(at)
                        last = int(us[at])
                i = j
            if keep:
                yield batch.take(pa.array(keep))

    ordered = picked.where(F.col(key).isNotNull() & F.col("emitted_at").isNotNull()).repartition(key).sortWithinPartitions(*names)
    return ordered.mapInArrow(run, picked.schema)


def throttle_stream(events: DataFrame, key: str, ts: str, gap_seconds: float = 0.25) -> DataFrame:
    """ST-3 on a stream: the last emitted time of each key is its state."""
    kind = events.schema[key].dataType.simpleString()

    def emit(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t in sorted(pd.concat(list(frames))[ts].tolist()):
            if last is None or (t - last).total_seconds() >= gap_seconds:
                out.append(t)
                last = t
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame({key: [group[0]] * len(out), "emitted_at": out})

    return events.groupBy(key).applyInPandasWithState(emit, f"{key} {kind}, emitted_at timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def heartbeat_timeouts(beats: DataFrame, key: str, ts: str, limit: str = "1 minute", now: Column | None = None) -> DataFrame:
    """ST-6, batch twin: keys whose last beat is older than the limit at ``now`` (default: the newest beat of all)."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last_ts"))
    if now is None:
        newest = beats.agg(F.max(ts).alias("__now"))
        last = last.join(F.broadcast(newest))
        now = F.col("__now")
    return last.where(F.col("last_ts") + F.expr(f"interval {limit}") < now).select(key, "last_ts")


def requeued(tasks: DataFrame, beats: DataFrame, key: str, ts: str, limit: str = "1 minute", now: Column | None = None, grace: str = "5 seconds") -> DataFrame:
    """ST-6: tasks after a sweep: processing ones that went silent are pending again.

    Completed and canceled tasks stay as they are, whatever their beats. A claim (``claimed_at``) counts as a beat that
    lasts ``grace`` longer.
    """
    seen = beats.select(key, F.col(ts).alias("__ts")).unionByName(tasks.where("claimed_at is not null").select(key, (F.col("claimed_at") + F.expr(f"interval {grace}")).alias("__ts")))
    silent = heartbeat_timeouts(seen, key, "__ts", limit, now).select(key, F.lit(True).alias("__silent"))
    gone = F.coalesce("__silent", F.lit(False)) & (F.col("status") == "Processing")
    return tasks.join(silent, key, "left").withColumns({"status": F.when(gone, "Pending").otherwise(F.col("status")), "requeued": gone}).drop("__silent")


def heartbeat_stream(beats: DataFrame, key: str, ts: str, limit_ms: int = 60_000) -> DataFrame:
    """ST-6 on a stream with a watermark: a key is reported when the watermark passes its last beat by the limit."""
    kind = beats.schema[key].dataType.simpleString()

    def watch(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [group[0]], "last_ts": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(f[ts].max().value // 1_000_000) for f in frames)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + limit_ms, state.getCurrentWatermarkMs() + 1))

    return beats.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, last_ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def live_beats(beats: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """ST-7, SNK-7: beats of tasks that are still live; late ones are dropped."""
    return beats.join(live.select(key), key, "left_semi")


def merged_progress(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """ST-8: per key the last value of every field that was given."""
    return rows.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields))


def first_claims(claims: DataFrame, key: str, order: list[str]) -> DataFrame:
    """ST-9: the first claim of each task wins."""
    return claims.groupBy(key).agg(F.min_by(F.struct(*[c for c in claims.columns if c != key]), F.struct(*order)).alias("c")).select(key, "c.*")


def split_states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """ST-14: a split state after all its setters, in order: the last status, and the last version of each kind that was given."""
    last = merged_progress(events, [key], order, ["status", "processed_version", "applied_version"])
    reset = F.col("status").isin("Pending", "Processing")
    return last.withColumn("applied_version", F.when(reset | F.col("applied_version").isNull(), 0).otherwise(F.col("applied_version")))


def scheduled_runs(spans: DataFrame, key: str, start: str, end: str, every: str) -> DataFrame:
    """ST-13: the times at which a periodic job runs within each span: at its start, then after every period."""
    return spans.select(key, F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {every}"))).alias("run_at"))


def lifecycle(events: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """ST-10, ST-14: a task's state, its retries (failures) and whether it ended."""
    out = events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count_if(F.col(status) == "Failed").alias("retries"))
    return out.withColumn("ended", F.col("status").isin("Completed", "Canceled"))


def recovered(tasks: DataFrame) -> DataFrame:
    """ST-11: after a crash what was processing is pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "Processing", "Pending").otherwise(F.col("status")))


def replayable(tasks: DataFrame, data: str = "data") -> DataFrame:
    """ST-12, FLT-10: pending tasks and failed ones with retries left, in queue order."""
    most = F.coalesce(F.get_json_object(data, "$.RetryFor").try_cast("int"), F.lit(0))
    return tasks.where((F.col("status") == "Pending") | ((F.col("status") == "Failed") & (F.col("retry_count") < most))).orderBy("ord", "id")


def idle_expired(inputs: DataFrame, key: str, ready: str, used: str, now: Column, ttl: str = "10 minutes") -> DataFrame:
    """ST-16: prepared inputs idle for longer than their time to live."""
    return inputs.where(F.greatest(ready, F.coalesce(used, ready)) + F.expr(f"interval {ttl}") < now).select(key)


def first_trigger(rows: DataFrame, key: str, order: list[str], condition: Column) -> DataFrame:
    """ST-18: the first row of each key where a condition holds: a signal fires once at most."""
    order_by = Window.partitionBy(key).orderBy(*order)
    return rows.where(condition).withColumn("__r", F.row_number().over(order_by)).where("__r = 1").drop("__r")


def last_changes(changes: DataFrame, keys: list[str], sequence: str, removed: str | None = None) -> DataFrame:
    """ST-4: the last change of each key; where ``removed`` marks it as a removal, what was pending for the key is gone too."""
    others = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("v")).select(*keys, "v.*")
    return last if removed is None else last.withColumn(removed, F.coalesce(removed, F.lit(False)))


def applied_changes(current: DataFrame, last: DataFrame, keys: list[str], removed: str) -> DataFrame:
    """ST-4: a table after the last changes: removed keys are gone, others have their new values."""
    kept = current.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(~F.col(removed)).select(*current.columns))


def upsert_batches(changes: DataFrame, keys: list[str], sequence: str, merge: Callable[[DataFrame, int], None], interval: str | None = "100 milliseconds", removed: str | None = None):
    """ST-4, ST-5: a stream writer that hands each micro-batch, last change per key, to ``merge``; start it to run.

    Without an interval it takes what there is and ends (ST-12's schedule).
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge(last_changes(batch, keys, sequence, removed), batch_id)

    writer = changes.writeStream.foreachBatch(apply)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def live_view(rows: DataFrame, condition: Column, order: list[Column]) -> DataFrame:
    """ST-5: a filtered and sorted view of the table that the stream keeps."""
    return rows.where(condition).orderBy(*order)


def file_events(spark, folder: str, pattern: str = "*.cbz", most: int = 100) -> DataFrame:
    """SRC-9, ST-17: new files under a folder as a stream (path, modificationTime), in bounded batches."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most)
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")
