"""Numeric functions: sizes, scales, statistics and decisions (F-13, F-14, F-18..F-20, A-15, A-16)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SAMPLES = 64  # Fixed value: how many samples a statistic looks back over.


def fit_within(width: Column, height: Column, most: int) -> Column:
    """F-13: struct (width, height) scaled to a largest side, halves rounded to even."""
    ratio = width.cast("double") / height
    small = (width <= most) & (height <= most)
    wide = width > height
    return F.struct(
        F.when(small, width).when(wide, F.lit(most)).otherwise(F.bround(most * ratio)).cast("int").alias("width"),
        F.when(small, height).when(wide, F.bround(most / ratio)).otherwise(F.lit(most)).cast("int").alias("height"),
    )


def combined_scale(resize: Column, smart: Column) -> Column:
    """F-14: the smaller scale; a null one does not count."""
    return F.least(F.coalesce(resize, F.lit(1.0)), F.coalesce(smart, F.lit(1.0)))


def thumbnail_ratio(width: Column, height: Column, most: int = 150) -> Column:
    """F-17: the scale at which both sides fit; above 1 for small images."""
    return F.least(F.lit(float(most)) / width, F.lit(float(most)) / height)


def is_due(since: Column, minutes: Column, now: Column) -> Column:
    """F-24: whether some minutes have passed since a time."""
    return since + F.make_dt_interval(mins=minutes) < now


def timeout_seconds(base_seconds: Column, pixels: Column) -> Column:
    """F-18: a base time for each megapixel, once at least."""
    return base_seconds * F.greatest(F.lit(1.0), pixels / 1_000_000)


def upper_bound_95(value: Column, *window) -> Column:
    """A-15: mean + 1.96 deviations; the deviation of one sample is 0. Over a window if one is given."""
    mean, deviation = F.avg(value), F.stddev_samp(value)
    if window:
        mean, deviation = mean.over(window[0]), deviation.over(window[0])
    return mean + 1.96 * F.coalesce(deviation, F.lit(0.0))


def last_samples(keys: list[str], order: list[Column], samples: int = SAMPLES) -> Window:
    """The window of A-16: a row and those before it, ``samples`` in all."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - samples, 0)


def rolling_quantile(value: Column, p: float, window) -> Column:
    """A-16: quantile with linear interpolation over the last samples."""
    return F.percentile(value, p).over(window)


def should_prefetch(remaining: Column, total: Column, per_page_95: Column, prefetch_seconds: Column, finalizing: Column | None = None) -> Column:
    """F-19: few pages left, or the time they need at most does not exceed what fetching takes; unknown times do not count."""
    eta = F.coalesce((prefetch_seconds > 0) & ~F.isnan(prefetch_seconds) & (remaining * per_page_95 <= prefetch_seconds), F.lit(False))
    decision = F.when(total <= 0, False).otherwise((remaining <= F.ceil(total * 0.25)) | (remaining <= 5) | eta)
    return decision if finalizing is None else F.when(finalizing, True).otherwise(decision)


def download_seconds(size: Column, bandwidth_p10: Column, fallback_p90: Column) -> Column:
    """F-20: size over slow bandwidth, else the slow fetch time; null where neither is known."""
    return F.coalesce(F.when((bandwidth_p10 > 0) & ~F.isnan(bandwidth_p10), size / bandwidth_p10), F.nanvl(fallback_p90, F.lit(None).cast("double")))


def should_claim(remaining: Column, download: Column, per_page_95: Column) -> Column:
    """F-20: claim unless the download is known to fit into the work that remains."""
    known = (download > 0) & per_page_95.isNotNull()
    return F.when((remaining <= 0) | ~F.coalesce(known, F.lit(False)), True).otherwise(download >= remaining * per_page_95)
