"""The stream operators on live streams, against their batch twins: late rows, restarts, removals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tomewright.streaming import operators as streams

DAY = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return DAY + dt.timedelta(seconds=seconds)


class Feed:
    """A file source: each call writes one file of rows, then the query takes what there is and ends; state is in its checkpoint."""

    def __init__(self, spark, tmp_path, schema: str):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0
        (tmp_path / "in").mkdir()

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))

    def put(self, rows) -> None:
        self.n += 1
        target = self.path / "stage" / str(self.n)
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(target))
        next(target.glob("*.parquet")).rename(self.path / "in" / f"{self.n:03}.parquet")

    def run(self, frame, mode: str = "append"):
        """Start anew from the checkpoint, take all files, end."""
        query = frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start(str(self.path / "out"))
        query.awaitTermination(120)
        return self.spark.read.schema(frame.schema).parquet(str(self.path / "out")).collect()


def test_debounce_over_restarts_and_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, ts timestamp, e string")
    made = lambda: streams.debounce(feed.stream().withWatermark("ts", "20 seconds"), ["k"], "ts", "e", "15 seconds")
    rows = [("a", at(0), "x"), ("a", at(10), "y"), ("b", at(5), "z"), ("a", at(40), "w")]
    feed.put(rows)
    feed.run(made())
    feed.put([("a", at(12), "in time"), ("b", at(200), "q")])  # within the watermark: joins the first burst
    feed.run(made())
    feed.put([("a", at(1), "too late"), ("b", at(400), "end")])
    feed.run(made())
    feed.put([("c", at(900), "tick")])
    got = {(r.k, r.e, r.last_ts, r.n) for r in feed.run(made())}
    every = [*rows, ("a", at(12), "in time"), ("b", at(200), "q"), ("b", at(400), "end")]
    batch = {(r.k, r.e, r.last_ts, r.n) for r in streams.debounce(spark.createDataFrame(every, feed.schema), ["k"], "ts", "e", "15 seconds").collect()}
    assert got == batch and ("a", "in time", at(12), 3) in got


def test_throttle_keeps_its_state_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, ts timestamp")
    rows = [(k, at(i / 10 + j / 100)) for j, k in enumerate("ab") for i in range(30)]
    for part in (rows[:7] + rows[30:41], rows[7:30], rows[41:]):
        feed.put(part)
        got = feed.run(streams.throttle_stream(feed.stream(), "k", "ts", 0.25))
    twin = streams.throttle(spark.createDataFrame(rows, feed.schema), "k", "ts", 0.25).collect()
    assert sorted((r.k, r.emitted_at) for r in got) == sorted((r.k, r.emitted_at) for r in twin)


def test_silent_tasks_are_reported_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, ts timestamp")
    made = lambda: streams.heartbeat_stream(feed.stream().withWatermark("ts", "0 seconds"), "k", "ts", 60_000)
    for part in ([("a", at(0)), ("b", at(0))], [("b", at(50))], [("b", at(100))], [("b", at(140)), ("c", at(141))], [("c", at(150))]):
        feed.put(part)
        got = feed.run(made())
    rows = [("a", at(0)), ("b", at(0)), ("b", at(50)), ("b", at(100)), ("b", at(140)), ("c", at(141)), ("c", at(150))]
    twin = streams.heartbeat_timeouts(spark.createDataFrame(rows, feed.schema), "k", "ts", "60 seconds").collect()
    assert [(r.k, r.last_ts) for r in got] == [(r.k, r.last_ts) for r in twin] == [("a", at(0))]


def test_micro_batches_upsert_and_remove(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, seq long, v int, removed boolean")
    table = {"now": spark.createDataFrame([("z", 9)], "k string, v int")}

    def merge(last, batch_id):
        rows = streams.applied_changes(table["now"], last, ["k"], "removed").collect()
        table["now"] = spark.createDataFrame(rows, "k string, v int")

    for part in ([("a", 1, 1, False), ("a", 2, 2, None), ("b", 3, 3, False), ("b", 4, 3, True)], [("a", 5, 0, True), ("z", 6, 1, True)], [("a", 7, 7, False), ("c", 8, 8, False)]):
        feed.put(part)
        query = streams.upsert_batches(feed.stream(), ["k"], "seq", merge, None, "removed").option("checkpointLocation", str(tmp_path / "state")).start()
        query.awaitTermination(120)
    view = streams.live_view(table["now"], F.col("v") > 0, [F.desc("v")]).collect()
    assert [tuple(r) for r in view] == [("c", 8), ("a", 7)]


def test_new_files_are_events(spark, tmp_path):
    folder = tmp_path / "library" / "deep"
    folder.mkdir(parents=True)
    for name in ("a.cbz", "b.txt", "c.cbz"):
        (folder / name).write_bytes(b"x")
    events = streams.file_events(spark, str(tmp_path / "library"), most=1)
    query = events.writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in spark.table("files").collect()) == ["a.cbz", "c.cbz"]
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2  # a file a batch


def test_idle_inputs_against_plain_python(spark):
    rows = [("a", at(0), None), ("b", at(0), at(300)), ("c", at(200), at(100)), ("d", at(500), None)]
    got = streams.idle_expired(spark.createDataFrame(rows, "k string, ready timestamp, used timestamp"), "k", "ready", "used", F.lit(at(901)))
    assert sorted(r.k for r in got.collect()) == sorted(k for k, ready, used in rows if max(ready, used or ready) + dt.timedelta(minutes=10) < at(901))


@pytest.mark.parametrize("gap", [0.25, 1.0])
def test_throttle_of_one_hot_key(spark, gap):
    rows = [("hot", at(i * 0.01)) for i in range(3000)] + [(None, at(1)), ("x", None), ("y", at(1))]
    got = streams.throttle(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", gap).collect()
    last, want = None, []
    for k, t in rows[:3000]:
        if last is None or (t - last).total_seconds() >= gap:
            want.append((k, t))
            last = t
    assert sorted((r.k, r.emitted_at) for r in got) == sorted([*want, ("y", at(1))])
