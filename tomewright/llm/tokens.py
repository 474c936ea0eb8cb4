"""Token counts by section: each text is encoded once, and token spans are joined to section spans.

A byte-level BPE gives token byte lengths; their running sum is mapped to characters. Sections are disjoint spans that
cover the text (by default its lines, each with its line end). The interval join is a binary search of both ends of
every token in the sorted section starts. Rule for a token that crosses boundaries: it goes to the section that holds
most of its characters, the earlier one on a tie; so a text's section counts add up to its token count.

Cases: null and empty texts give one empty section 0 with no token; texts of any length are encoded whole; repeated rows
give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches

_ENCODERS: dict[str, tuple] = {}


def byte_encoder(path: str, pattern: str):
    """The encoder of a rank file and the byte length of each id; kept for the worker's life."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[path]


def line_starts(text: str) -> np.ndarray:
    """Character offsets at which lines begin; a line holds its line end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], starts[starts < len(codes)]])


def token_spans(ids: np.ndarray, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens: from the character that holds a token's first byte to that of its last."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token by the rule above, and whether the token crosses a boundary."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crosses = first != last
    limits = np.append(sections, size)
    for t in np.flatnonzero(crosses):
        among = np.arange(first[t], last[t] + 1)
        held = np.minimum(limits[among + 1], ends[t]) - np.maximum(limits[among], starts[t])
        first[t] = among[held.argmax()]
    return first, crosses


def section_tokens(docs: DataFrame, id_cols: list[str], tokenizer_path: str, pattern: str, text: str = "text", sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """One row per text and section: section, start, end (characters), n_tokens, n_crossing, and the text's doc_tokens."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = byte_encoder(tokenizer_path, pattern)
        for batch in batches(source):
            parts, rows = [], []
            for value in batch.column(batch.num_columns - 1):
                body = value.as_py() or ""
                bounds = sections(body)
                size = len(body)
                ids = np.array(encoder.encode_ordinary(body), dtype=np.int64)
                if len(ids):
                    where, crosses = attribute(*token_spans(ids, lengths, body), bounds, size)
                    n, x = np.bincount(where, minlength=len(bounds)), np.bincount(where[crosses], minlength=len(bounds))
                else:
                    n = x = np.zeros(len(bounds), np.int64)
                parts.append((np.arange(len(bounds)), bounds, np.append(bounds[1:], size), n, x, np.full(len(bounds), len(ids))))
                rows.append(len(bounds))
            at = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            table = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
            out = pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *table], names=[*batch.schema.names[:-1], "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])
            for i in range(0, out.num_rows, 50_000):
                yield out.slice(i, 50_000)

    picked = docs.select(*id_cols, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(count, ", ".join([*fields, "section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"]))
