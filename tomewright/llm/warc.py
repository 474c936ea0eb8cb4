"""WARC archives: whole-file gzip streams, their normalisation to one member per record, and reading back by index.

Writing makes one archive per task as a single gzip stream, as careless crawlers do. The normaliser inflates such a
stream once, in bounded chunks, rewrites every record as a gzip member of its own and writes a sidecar index of member
offsets, so any record can be read by one seek. Files are written under an attempt's own name and renamed when whole,
so a retried or speculative task leaves one valid file. Paths are URIs that pyarrow's file systems open.

Cases: null html is an empty payload; payloads under ``min_revisit`` bytes are all responses; a digest held by rows of
one page_id only makes no revisit; a null page_id never answers for others' revisits and revisits a copy like others;
an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import batches

VERSION = b"WARC/1.1"
_READ = 1 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, record_id: str, target: str, payload: bytes, digest: str, full_length: int, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit carries no block but the digest and length of the payload it stands for."""
    block = b"" if kind == "revisit" else payload
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", target), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(full_length)), ("Content-Type", "text/html; charset=utf-8"),
        *([("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to else []),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in head)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class RecordReader:
    """Records of an uncompressed WARC byte stream, fed in chunks; holds at most one record and a chunk."""

    def __init__(self) -> None:
        self.pending = bytearray()

    def feed(self, chunk: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, whole record) of each record completed by ``chunk``."""
        self.pending += chunk
        at = 0
        while True:
            stop = self.pending.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            headers = parse_headers(bytes(self.pending[at:stop]))
            end = stop + 4 + int(headers["content-length"]) + 4
            if len(self.pending) < end:
                break
            yield headers, bytes(self.pending[at:end])
            at = end
        del self.pending[:at]


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def block_of(headers: dict[str, str], whole: bytes) -> bytes:
    return whole[-4 - int(headers["content-length"]) : -4]


def inflate(source, size: int = _READ) -> Iterator[bytes]:
    """Chunks of a gzip stream of one or many members, inflated once, in bounded memory."""
    inflater = zlib.decompressobj(31)
    while data := source.read(size):
        while data:
            yield inflater.decompress(data, 4 * size)
            while inflater.unconsumed_tail:
                yield inflater.decompress(inflater.unconsumed_tail, 4 * size)
            data = inflater.unused_data
            if inflater.eof:
                inflater = zlib.decompressobj(31)
    tail = inflater.flush()
    if tail:
        yield tail


def normalise(source_uri: str, target_uri: str, attempt: str, level: int = 6) -> list[tuple[str, int, int]]:
    """Rewrite one archive record by record; its index (record id, offset, length), also written as a sidecar."""
    fs, source = open_fs(source_uri)
    out_fs, target = open_fs(target_uri)
    index, offset, reader = [], 0, RecordReader()
    with fs.open_input_stream(source, compression=None) as raw, out_fs.open_output_stream(f"{target}.{attempt}", compression=None) as out:
        for chunk in inflate(raw):
            for headers, whole in reader.feed(chunk):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(whole) + packer.flush()
                out.write(member)
                index.append((headers["warc-record-id"].strip("<>"), offset, len(member)))
                offset += len(member)
    if reader.pending:
        raise ValueError(f"{source_uri} ends inside a record")
    with out_fs.open_output_stream(f"{target}.idx.{attempt}", compression=None) as side:
        side.write("".join(f"{i}\t{at}\t{n}\n" for i, at, n in index).encode())
    out_fs.move(f"{target}.idx.{attempt}", f"{target}.idx")
    out_fs.move(f"{target}.{attempt}", target)
    return index


def read_index(target_uri: str) -> list[tuple[str, int, int]]:
    fs, target = open_fs(target_uri)
    with fs.open_input_stream(f"{target}.idx", compression=None) as side:
        return [(i, int(at), int(n)) for i, at, n in (line.split("\t") for line in side.read().decode().splitlines())]


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of an open, normalised archive by its place in the index."""
    source.seek(offset)
    whole = zlib.decompress(source.read(length), 31)
    return parse_headers(whole[: whole.index(b"\r\n\r\n")]), whole


def with_revisits(pages: DataFrame, min_revisit: int = 100, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Rows of pages with their payload's digest and, for revisits, the smallest page_id that holds the same payload.

    Only digests reach the aggregate, which keeps one row per digest and task before its shuffle; only digests of more
    than one page are joined, so a payload that many pages share is split by the adaptive skew join.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    shared = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    shared = shared.where("first_id <> last_id or (first_id is not null and nameless > 0)").select("digest", "first_id")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write rows of :func:`with_revisits` as whole-stream archives, one per task: (archive, records)."""

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        fs, base = open_fs(folder)
        temporary, packer, n, out = f"{base}/.{name}.{context.taskAttemptId()}", zlib.compressobj(level, zlib.DEFLATED, 31), 0, None
        for batch in batches(source):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(temporary, compression=None)
            for i in range(batch.num_rows):
                page, url, html, digest, size, refers = (c[i].as_py() for c in batch.columns)
                whole = record("response" if refers is None else "revisit", f"urn:page:{'' if page is None else page}", url, html.encode() if refers is None else b"", digest, size, None if refers is None else f"urn:page:{refers}")
                out.write(packer.compress(whole))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            fs.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([n], pa.int64())})

    return rows.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(write, "archive string, records long")


def normalise_archives(spark: SparkSession, archives: list[str], source: str, target: str, level: int = 6) -> DataFrame:
    """Normalise archives by name, each in a task of its own: (archive, records, bytes)."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(target)
        fs.create_dir(base, recursive=True)
        for batch in batches(batches_):
            for name in batch.column(0).to_pylist():
                index = normalise(f"{source}/{name}", f"{target}/{name}", str(TaskContext.get().taskAttemptId()), level)
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([sum(n for *_, n in index)], pa.int64())})

    return _by_name(spark, archives).mapInArrow(run, "archive string, records long, bytes long")


def _by_name(spark: SparkSession, archives: list[str]) -> DataFrame:
    """A row an archive, each in a partition of its own."""
    shared, n = spark.sparkContext.broadcast(archives), len(archives)

    def name(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            yield pa.RecordBatch.from_pydict({"archive": pa.array([shared.value[i] for i in batch.column(0).to_pylist()], pa.string())})

    return spark.range(0, n, 1, max(1, n)).mapInArrow(name, "archive string")


def read_archives(spark: SparkSession, archives: list[str], folder: str) -> DataFrame:
    """Every record of normalised archives, read member by member through the sidecar index.

    payload_digest is computed anew for responses and checked against the header; revisits name it in theirs.
    """

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for name in batch.column(0).to_pylist():
                index = read_index(f"{folder}/{name}")
                fs, base = open_fs(folder)
                rows = []
                with fs.open_input_file(f"{base}/{name}") as archive:
                    for record_id, offset, length in index:
                        headers, whole = read_member(archive, offset, length)
                        kind, digest, size = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        if kind == "response":
                            block = block_of(headers, whole)
                            if hashlib.sha256(block).hexdigest() != digest or len(block) != size:
                                raise ValueError(f"{name}: {record_id} does not hold its payload")
                        refers = headers.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
                        page = record_id.removeprefix("urn:page:")
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, name, offset, length))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])

    return _by_name(spark, archives).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")
