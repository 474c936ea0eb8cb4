"""Best-fit packing of tokenised texts into sequences by bin completion.

Texts become token ids once, word by word: white space never stands inside a pre-token, so a text's ids are those of its
chunks between white space, and the ids of short chunks are kept while a task lasts. Texts longer than a sequence are cut into
full pieces and a rest. Pieces are dealt by a hash into blocks of bounded size; each block is solved by branch and
bound: the largest piece left opens a bin, its undominated fillings are tried from the least waste on, a branch ends
when its waste exceeds what a better solution may waste, and best-fit decreasing is the first incumbent. Bins that stay
far from full are opened again and packed together in further rounds, so blocks cost next to nothing.

Cases: null text is empty and is packed as its end mark; repeated rows are packed each; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, trim, written

#: Chunks and pre-tokens of at most so many characters whose ids a task keeps (about 0.2 KB each); it starts over
#: beyond that number, which costs time only.
KEPT_CHUNKS, KEPT_PIECES, KEPT_CHARS = 600_000, 400_000, 48
_SEPARATOR = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed: the tokenizer's own split
_LATIN = "\u024f"
_TOKENIZERS: dict[str, WordEncoder] = {}


def _id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class WordEncoder:
    """A tokenizer whose pre-tokens end in ``</w>``, with the ids of chunks and pre-tokens met so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a chunk with a special token inside is not split as other chunks are
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        self.chunks.clear()
        self.pieces.clear()

    def _learn_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of many pre-tokens from few encodings: joined by blanks, each ends at an id of a word's end."""
        fresh: dict[str, bytes] = {}
        for i in range(0, len(pieces), 2048):
            part = pieces[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                fresh.update((p, raw[at[k] : at[k + 1]]) for k, p in enumerate(part))
            else:
                fresh.update((p, self.whole(p)) for p in part)
        return fresh

    def learn(self, chunks: set[str], special: bool) -> dict[str, bytes]:
        """The ids of chunks without white space; those of short ones are kept. ``special``: special tokens may be inside."""
        have = self.pieces
        known = {c: self.whole(c) for c in chunks if self.special.search(c)} if special else {}
        lower: dict[str, str] = {}
        for chunk in chunks - known.keys() if known else chunks:
            if chunk.isascii():
                lower[chunk] = chunk.lower()
            elif max(chunk) <= _LATIN:
                lower[chunk] = unicodedata.normalize("NFC", chunk).lower()
            else:
                known[chunk] = self.whole(chunk)
        split = {chunk: _PIECE.findall(low) for chunk, low in lower.items() if not low.isalpha()}  # letters alone are one piece
        wanted = {low for chunk, low in lower.items() if chunk not in split}.union(*split.values())
        ids = self._learn_pieces(list(wanted.difference(have)))
        kept = {p: x for p, x in ids.items() if len(p) <= KEPT_CHARS}
        ids.update((p, have[p]) for p in wanted if p not in ids)
        for chunk, low in lower.items():
            known[chunk] = b"".join([ids[p] for p in split[chunk]]) if chunk in split else ids[low]
        have.update(kept)
        self.chunks.update(known if max(map(len, known), default=0) <= KEPT_CHARS else {c: x for c, x in known.items() if len(c) <= KEPT_CHARS})
        return known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's token ids as little-endian 32-bit words."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if _SEPARATOR.search(t)}
        chunked = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        new = set().union(*chunked).difference(self.chunks)
        known = self.learn(new, any(self.special.search(t) for t in texts))
        find = self.chunks.__getitem__ if len(known) == 0 or known.keys() <= self.chunks.keys() else lambda c: known[c] if c in known else self.chunks[c]
        return [self.whole(texts[i]) if i in odd else b"".join(map(find, chunks)) for i, chunks in enumerate(chunked)]


def word_encoder(path: str) -> WordEncoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, slice_chars: int = 2_000_000) -> DataFrame:
    """Pieces of every text: piece_key, doc_id, piece, start, length, ids_crc32."""
    mark = _id_bytes([end_id])
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encoder = TaskContext.get().partitionId() << 36, word_encoder(tokenizer_path)
        try:
            for batch in batches(source):
                texts = batch.column(1).to_pylist()
                rows, out = [], []
                i = 0
                while i < len(texts):
                    j, size = i, 0
                    while j < len(texts) and (j == i or size < slice_chars):
                        size += len(texts[j] or "")
                        j += 1
                    for k, ids in enumerate(encoder.encode(texts[i:j]), i):
                        ids += mark
                        step = 4 * capacity
                        for p, at in enumerate(range(0, len(ids), step)):
                            part = ids[at : at + step]
                            rows.append(k)
                            out.append((number, p, at // 4, len(part) // 4, zlib.crc32(part)))
                            number += 1
                    i = j
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], batch.column(0).take(pa.array(rows)), *columns[1:]], names=["piece_key", "doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            encoder.forget()  # the worker goes on to other operators' tasks
            trim()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, f"piece_key long, doc_id {kind}, piece long, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of positions in ``sizes``."""
    bins: list[list[int]] = []
    space: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(space, (sizes[i], -1))
        if at == len(space):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = space.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        insort(space, (room, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the volume bound and the bound that counts items of over half a bin apart."""
    best = -(-sum(sizes) // capacity)
    ordered = sorted(sizes)
    total = [0, *np.cumsum(ordered).tolist()]
    for k in sorted({s for s in ordered if s <= capacity // 2})[:200]:
        big = len(ordered) - bisect_right(ordered, capacity - k)
        half = bisect_right(ordered, capacity // 2)
        over = bisect_right(ordered, capacity - k)
        low = bisect_left(ordered, k)
        middle = over - half
        rest = total[half] - total[low] - (middle * capacity - (total[over] - total[half]))
        best = max(best, big + middle + max(0, -(-rest // capacity)))
    return best


class _Stock:
    """Items left, by size: sorted sizes with counts."""

    def __init__(self, sizes: list[int]):
        self.sizes = sorted(set(sizes))
        self.count = dict.fromkeys(self.sizes, 0)
        for s in sizes:
            self.count[s] += 1

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def give(self, size: int) -> None:
        if not self.count.get(size):
            insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + 1


def fillings(stock: _Stock, room: int, width: int, depth: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first: none may grow by a piece left or swap one for a larger.

    ``width`` and ``depth`` bound how many choices are followed at each step and how many pieces are added by choice;
    beyond depth the largest piece that fits is taken.
    """
    found: dict[tuple[int, ...], int] = {}

    def greedy(room: int, chosen: tuple[int, ...], at: int) -> None:
        rest, had = list(chosen), {size: chosen.count(size) for size in set(chosen)}
        while at >= 0:  # a run of equal pieces is taken at once
            size = stock.sizes[at]
            n = min(stock.count[size] - had.get(size, 0), room // size)
            rest += [size] * n
            room -= n * size
            at = min(at, bisect_right(stock.sizes, room)) - 1
        found[tuple(rest)] = room

    def extend(room: int, chosen: tuple[int, ...], most: int, depth: int) -> None:
        at = bisect_right(stock.sizes, min(room, most)) - 1
        if depth <= 0:
            return greedy(room, chosen, at)
        taken = 0
        while at >= 0 and taken < width:
            size = stock.sizes[at]
            if stock.count[size] > chosen.count(size):
                extend(room - size, (*chosen, size), size, depth - 1)
                taken += 1
                if size == room:
                    return
            at -= 1
        if not taken:
            found[chosen] = room

    extend(room, (), room, depth)
    ordered = sorted(found, key=lambda c: (found[c], len(c), tuple(-x for x in c)))
    return [c for i, c in enumerate(ordered) if not any(found[d] <= found[c] and _dominates(d, c) for d in ordered[:i])]


def _dominates(d: tuple[int, ...], c: tuple[int, ...]) -> bool:
    """Whether c's pieces can be put, each group within one piece of d (Martello and Toth's rule; greedy test)."""
    room = sorted(d)
    for size in sorted(c, reverse=True):
        at = bisect_left(room, size)
        if at == len(room):
            return False
        left = room.pop(at) - size
        insort(room, left)
    return True


def complete(sizes: list[int], capacity: int, nodes: int = 3_000, width: int = 4, depth: int = 2) -> list[list[int]]:
    """Bins (positions in ``sizes``) of the best packing found by bin completion.

    Pieces that no other piece fits beside stand alone in every packing and are not searched. The search follows
    ``nodes`` nodes, or four for each bin of best fit if that is more, so it gets to whole packings at any size.
    """
    least = min(sizes, default=0)
    alone = [[i] for i, s in enumerate(sizes) if s + least > capacity]
    if alone and len(sizes) > 1:
        rest = [i for i, s in enumerate(sizes) if s + least <= capacity]
        return alone + [[rest[k] for k in b] for b in complete([sizes[i] for i in rest], capacity, nodes, width, depth)]
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best
    nodes = max(nodes, 4 * len(best))
    total = sum(sizes)
    stock = _Stock(sizes)
    path: list[tuple[int, ...]] = []
    choices: list[list[tuple[int, ...]]] = []
    waste = opened = 0

    def options() -> list[tuple[int, ...]]:
        top = stock.sizes[-1]
        stock.take(top)
        got = [(top, *c) for c in fillings(stock, capacity - top, width, depth)][:width]
        stock.give(top)
        return got[::-1]

    def undo() -> None:
        nonlocal waste
        last = path.pop()
        waste -= capacity - sum(last)
        for s in last:
            stock.give(s)

    choices.append(options())
    while choices and opened < nodes:
        if not choices[-1]:
            choices.pop()
            if path:
                undo()
            continue
        pick = choices[-1].pop()
        allowed = (len(best) - 1) * capacity - total
        if waste + capacity - sum(pick) > allowed:  # no completion of this branch beats the incumbent
            continue
        opened += 1
        path.append(pick)
        waste += capacity - sum(pick)
        for s in pick:
            stock.take(s)
        if not stock.sizes:
            if len(path) < len(best):
                by_size: dict[int, list[int]] = {}
                for i, s in enumerate(sizes):
                    by_size.setdefault(s, []).append(i)
                best = [[by_size[s].pop() for s in b] for b in path]
                if len(best) <= bound:
                    return best
            undo()
        else:
            choices.append(options())
    return best


def _solver(capacity: int, nearly_full: float, first: int, last: bool):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece_key", ignore_index=True)
        sizes = frame["length"].tolist()
        block_id = int(frame["block"].iloc[0])
        rows, sequence, place, settled = [], [], [], []
        for b, items in enumerate(complete(sizes, capacity)):
            items = sorted(items)
            full = last or sum(sizes[i] for i in items) >= nearly_full * capacity
            at = 0
            for i in items:
                rows.append(i)
                sequence.append(first + (block_id << 24) + b)
                place.append(at)
                settled.append(full)
                at += sizes[i]
        return pd.DataFrame({"piece_key": frame["piece_key"].to_numpy()[rows], "length": np.array(sizes)[rows], "sequence_id": sequence, "offset": place, "settled": settled})

    return solve


def pack(pieces: DataFrame, capacity: int = 4096, block: int = 4096, rounds: int = 2, nearly_full: float = 0.97) -> DataFrame:
    """``pieces`` (piece_key, length, ...) with sequence_id and offset; every piece lies gapless in one sequence."""
    keep = pieces.columns
    rest, done = pieces.select("piece_key", "length"), []
    for step in range(rounds):
        n = rest.count()
        blocks = max(1, -(-n // block))
        last = step == rounds - 1 or blocks == 1

        dealt = rest.withColumn("block", F.pmod(F.xxhash64("piece_key", F.lit(step)), F.lit(blocks)))
        solved = written(dealt.groupBy("block").applyInPandas(_solver(capacity, nearly_full, step << 52, last), "piece_key long, length long, sequence_id long, offset long, settled boolean"), f"packed{step}")
        done.append(solved.where("settled").select("piece_key", "sequence_id", "offset"))
        if last:
            break
        rest = solved.where("not settled").select("piece_key", "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return pieces.join(placed, "piece_key").select(*keep, "sequence_id", "offset")
