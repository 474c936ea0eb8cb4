"""Shared working folder and small distributed helpers used by several operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Spark's own setting: a query's shuffle files go when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master (one machine, as in tests); on a cluster executors
    would write into folders of their own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tomewright-")
    return _FALLBACK[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tomewright/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder`, whatever file system it is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def _write(df: DataFrame, path: str, codec: str) -> DataFrame:
    with dropping_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor.

    The shuffle files that made it are dropped as soon as it is written.
    """
    return _write(df, new_folder(df.sparkSession, name), codec)


class Scratch:
    """Written tables of one run, by name; a table that a later one supersedes can be dropped at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` under a name and read it back; a table of that name is dropped afterwards."""
        path, old = new_folder(self.spark, name), self.paths.get(name)
        out = _write(df, path, codec)
        self.paths[name] = path
        if old:
            remove_folder(self.spark, old)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove_folder(self.spark, path)


def collected(df: DataFrame) -> pd.DataFrame:
    """A result of bounded size as a pandas frame, sent to the driver in Arrow's columns."""
    return df.toArrow().to_pandas()


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its offsets (rows + 1), null texts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that together hold at most ``limit`` bytes (a longer row stands alone)."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def with_row_key(docs: DataFrame, name: str, first: str) -> DataFrame:
    """``docs`` with a struct column ``name`` that no two rows share and that every scan gives a row again.

    It orders by the column ``first``, nulls last, then by the row's place in its file; rows that come from no file are
    written first.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    key = F.struct(F.col(first).isNull().alias("nameless"), F.col(first).alias("id"), *place).alias(name)
    try:
        return docs.select("*", key)
    except AnalysisException:
        return written(docs, "rows").select("*", key)


def trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; at their end the worker gives back what memory is free, as it goes on to other tasks."""
    for batch in source:
        if batch.num_rows:
            yield batch
    trim()


def bit_filter(keys: DataFrame, key: str, log2_bits: int = 24) -> np.ndarray:
    """A two-probe Bloom filter over a column of 64-bit keys, as uint64 words.

    Built with a JVM aggregate; what reaches the driver is at most 2**log2_bits bits, whatever the number of keys.
    A fuller filter lets more through and loses nothing, since callers join exactly afterwards.
    """
    mask = (1 << log2_bits) - 1
    probes = F.array(
        F.col(key).bitwiseAND(F.lit(mask)),
        F.shiftrightunsigned(F.col(key), 64 - log2_bits).bitwiseAND(F.lit(mask)),
    )
    rows = collected(
        keys.select(F.explode(probes).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys the filter may hold."""
    bits = int(len(words) * 64).bit_length() - 1
    mask = np.uint64((1 << bits) - 1)
    u = keys.view(np.uint64)
    found = np.ones(len(u), dtype=bool)
    for probe in (u & mask, (u >> np.uint64(64 - bits)) & mask):
        found &= (words[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63))) & np.uint64(1) != 0
    return found
