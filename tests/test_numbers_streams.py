import numpy as np
from pyspark.sql import functions as F

from tomewright.functions import images, numbers
from tomewright.operators import match
from tomewright.streaming import operators as streams


def test_claims_and_prefetch(spark):
    rows = [(5, 100.0, 10.0, True), (5, 0.1, 10.0, False), (0, 0.1, 10.0, True), (5, None, 10.0, True), (5, 1.0, None, True)]
    df = spark.createDataFrame(rows, "remaining int, download double, p95 double, want boolean")
    assert all(r.got == r.want for r in df.select("want", numbers.should_claim(F.col("remaining"), F.col("download"), F.col("p95")).alias("got")).collect())
    rows = [(100, 200, None, None, False), (50, 200, None, None, True), (5, 6, None, None, True), (100, 200, 1.0, 100.0, True), (1, 0, None, None, False)]
    df = spark.createDataFrame(rows, "remaining int, total int, p95 double, fetch double, want boolean")
    assert all(r.got == r.want for r in df.select("want", numbers.should_prefetch(F.col("remaining"), F.col("total"), F.col("p95"), F.col("fetch")).alias("got")).collect())


def test_throttle_follows_what_was_emitted(spark):
    df = spark.createDataFrame([("a", i * 100) for i in range(8)], "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    got = [r.emitted_at.microsecond // 1000 for r in streams.throttle(df, "k", "ts", 0.25).orderBy("emitted_at").collect()]
    assert got == [0, 300, 600]


def test_perceptual_hash_against_plain_sums():
    pixels = np.arange(64, dtype=float).reshape(8, 8) ** 1.5 % 17
    c = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            w = np.cos((2 * np.arange(8)[:, None] + 1) * u * np.pi / 16) * np.cos((2 * np.arange(8)[None, :] + 1) * v * np.pi / 16)
            c[v, u] = (pixels * w).sum() / 4 * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1)
    flat = c.ravel()
    want = int("".join("1" if x > np.median(flat) else "0" for x in flat), 2)
    assert images.phash(pixels) % (1 << 64) == want


def test_near_hashes_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    pics = [(i, f"x{i}", base ^ sum(1 << int(b) for b in rng.choice(62, i % 12, replace=False))) for i in range(60)]
    got = match.match_filters(spark.createDataFrame(pics, "image_id int, content_hash string, phash long"), spark.createDataFrame([(1, 1, "f", base)], "filter_id int, ord int, content_hash string, phash long"), 90.0)
    assert sorted(r.image_id for r in got.collect()) == [i for i, _, p in pics if (p ^ base).bit_count() <= 6]
