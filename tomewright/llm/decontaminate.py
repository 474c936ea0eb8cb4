"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Texts are words (ASCII letters and digits and non-ASCII characters, A-Z lowered). A benchmark's vocabulary spans the
feature space: other words have no product with any item. Passages are overlapping windows of ``window`` words as TF-IDF
vectors, document frequencies being counted over all documents. A randomised SVD (range of XᵀXΩ, summed over tasks)
gives the latent space; its rows are the items, weighted to ``item_weight`` times the energy of all others, and the passages
of all documents. Every passage of every document is projected; items of a cosine of
at least ``min_cosine`` are candidates. A candidate leaks if the longest common subsequence of the item with the words
around the passage covers ``min_lcs`` of it, and, below ``sure_lcs``, if most of the answer is there too: the quarter of
the item's words that is rarest in the corpus.

The benchmark is taken in blocks, each with its own space: at most ``block_items`` items and as many passages as the space
has ranks; an item of more passages lies in several blocks. ``scan_blocks`` blocks go through one scan of the corpus for
document frequencies, one for the range and one for the search, so what a task holds is bounded. A passage of which the
space keeps less than ``min_energy`` has its own direction added, so its copies keep their cosine whatever else is in the
block.

Cases: null, empty and wordless texts and items leak nothing; items longer than ``item_words`` are cut into passages
that are checked each; repeated rows and items are reported each; an empty table on either side gives no row. An item so
long that its blocks need several scans is reported from each scan that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .workspace import batches, collected, dropping_shuffles, row_slices, text_buffers

CHUNK = 1 << 19
#: Tokens whose rows are summed at once; they stay in the cache.
STRETCH = 512
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass
class Settings:
    window: int = 32
    rank: int = 256
    item_weight: float = 16.0
    min_energy: float = 0.9
    min_cosine: float = 0.3
    min_lcs: float = 0.6
    sure_lcs: float = 0.85
    min_answer: float = 0.5
    block_items: int = 256
    scan_blocks: int = 4
    item_words: int = 64
    seed: int = 11


@dataclass
class Passage:
    """A checked stretch of an item: its words, its bit mask by word, the words of its answer, and its own words' positions
    in the vocabulary, sorted, with their counts."""

    item: object
    words: np.ndarray
    masks: dict[int, int]
    answer: np.ndarray
    own: np.ndarray
    counts: np.ndarray


@dataclass
class Index:
    """A block of items in its latent space."""

    settings: Settings
    vocabulary: np.ndarray
    idf: np.ndarray
    scores: np.ndarray  # what one word adds to a passage's latent product with each item
    passages: list[Passage]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        return _terms(self.vocabulary, hashes)


def _terms(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions in the sorted vocabulary, -1 for other words."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    _, _, row, h = words.scan(raw, offsets, WORD)
    return np.split(h, np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else []


def _word_runs(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_buffers(column)
    for i, j in row_slices(offsets, most):
        _, _, row, h = words.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD)
        yield i, j, row, h


class Windows:
    """Half-window steps of consecutive rows; window k is step k and the next one of the same row."""

    def __init__(self, row: np.ndarray, rows: int, window: int):
        self.half = window // 2
        self.first_word = np.searchsorted(row, np.arange(rows + 1))
        self.counts = np.diff(self.first_word)
        steps = -(-self.counts // self.half)
        self.first_step = np.concatenate([[0], np.cumsum(steps)])
        self.n = int(self.first_step[-1])
        self.row = np.repeat(np.arange(rows), steps)
        within = np.arange(len(row)) - self.first_word[row]
        self.step = self.first_step[row] + within // self.half
        self.joined = np.zeros(self.n, dtype=bool)
        self.joined[:-1] = self.row[1:] == self.row[:-1]

    def add_next(self, x: np.ndarray) -> np.ndarray:
        out = x.copy()
        out[:-1][self.joined[:-1]] += x[1:][self.joined[:-1]]
        return out

    def sums(self, step: np.ndarray, rows_of: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Sum of ``rows_of[term]`` over each window, for tokens in order of step."""
        width = rows_of.shape[1]
        out = np.zeros((self.n, width), rows_of.dtype)
        if not len(step):
            return out
        counts = np.bincount(step, minlength=self.n)
        first = np.cumsum(counts) - counts
        depth = int(counts.max())
        table = np.full((depth, self.n), len(rows_of), np.int32)  # no term adds the row of zeros
        table[np.arange(len(step)) - first[step], step] = term
        padded = np.concatenate([rows_of, np.zeros((1, width), rows_of.dtype)])
        for a in range(0, self.n, 512):  # a stretch of steps stays in the cache
            part = out[a : a + 512]
            for k in range(depth):
                part += padded[table[k, a : a + 512]]
        return self.add_next(out)

    def span(self, k: int) -> tuple[int, int]:
        """First and last word (exclusive) of a window, counted within its row."""
        r = self.row[k]
        a = (k - self.first_step[r]) * self.half
        return int(a), int(min(a + 2 * self.half, self.counts[r]))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each word occurs, and the number of rows; one vector per task is sent."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        df, n = np.zeros(len(v), np.int64), 0
        for batch in batches(source):
            for i, j, row, h in _word_runs(batch.column(0), 1 << 22):
                term = _terms(v, h)
                ok = term >= 0
                cell = np.unique(row[ok] * len(v) + term[ok])
                df += np.bincount(cell % len(v), minlength=len(v))
                n += j - i
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"t": pa.array([-1, *at], pa.int64()), "df": pa.array([n, *df[at]], pa.int64())})

    rows = collected(docs.select(text).mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")))
    df = np.zeros(len(vocabulary), np.int64)
    real = rows["t"] >= 0
    df[rows.loc[real, "t"]] = rows.loc[real, "df"]
    return df, int(rows.loc[~real, "df"].sum())


def _matrix_rows(b: np.ndarray, t: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(t, pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["b", "t", "x"])


def corpus_range(docs: DataFrame, spaces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], settings: Settings, text: str = "text") -> list[tuple[np.ndarray, float]]:
    """For each space (vocabulary, idf, omega) XᵀXΩ over the passages of all documents, and their energy.

    One scan for all spaces; one matrix of fixed size for each space and task is sent, a row of it as one value, and rows
    are summed where they arrive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spaces)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = [(o * weight[:, None]).astype(np.float32) for _, weight, o in shared.value]
        total, energy = [np.zeros(w.shape) for w in weighted], [0.0] * len(weighted)
        for batch in batches(source):
            for i, j, row, h in _word_runs(batch.column(0)):
                windows = Windows(row, j - i, settings.window)
                for b, (v, weight, _) in enumerate(shared.value):
                    term = _terms(v, h)
                    ok = term >= 0
                    y = windows.sums(windows.step[ok], weighted[b], term[ok])
                    back = y.copy()  # a token is in its step's window and in the one before
                    back[1:][windows.joined[:-1]] += y[:-1][windows.joined[:-1]]
                    order = np.argsort(term[ok], kind="stable")
                    t, s = term[ok][order], windows.step[ok][order]
                    for a in range(0, len(t), STRETCH):
                        some, at = t[a : a + STRETCH], s[a : a + STRETCH]
                        begins = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
                        total[b][some[begins]] += np.add.reduceat(back[at], begins, axis=0) * weight[some[begins], None]
                    energy[b] += 2 * float((weight[t] ** 2).sum())
        for b, sums in enumerate(total):
            at = np.flatnonzero(sums.any(1))
            yield _matrix_rows(np.full(len(at) + 1, b), np.array([-1, *at]), [x.astype(np.float32) for x in (np.full(sums.shape[1], energy[b]), *sums[at])])

    def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches(source):
            for b, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = np.frombuffer(x, np.float32)
                if (b, t) in total:
                    total[b, t] += row
                else:
                    total[b, t] = row.astype(np.float64)
        if total:
            yield _matrix_rows(*np.array(list(total)).T, list(total.values()))

    schema = "b long, t long, x binary"
    with dropping_shuffles(docs.sparkSession):
        rows = collected(docs.select(text).mapInArrow(run, schema).repartition("b", "t").mapInArrow(merge, schema))
    out = []
    for b, (vocabulary, _, omega) in enumerate(spaces):
        mine = rows[rows["b"] == b]
        at, values = mine["t"].to_numpy(), np.frombuffer(b"".join(mine["x"])).reshape(-1, omega.shape[1])
        matrix = np.zeros((len(vocabulary), omega.shape[1]))
        matrix[at[at >= 0]] = values[at >= 0]
        out.append((matrix, float(values[at < 0].mean()) if (at < 0).any() else 0.0))
    return out


def item_passages(item: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """An item's words, in half-overlapping passages if it is longer than ``item_words``; none of a wordless item."""
    half = settings.item_words // 2
    return [item[a : a + settings.item_words] for a in range(0, max(1, len(item) - half), half) if len(item)]


def with_lost_directions(basis: np.ndarray, x: np.ndarray, min_energy: float) -> np.ndarray:
    """``basis`` and what it lacks of the rows of ``x`` (of length 1) that it keeps less than ``min_energy`` of."""
    lost = x[((x @ basis) ** 2).sum(1) < min_energy]
    if not len(lost):
        return basis
    for _ in range(2):  # the second time removes what rounding left
        lost = lost - (lost @ basis) @ basis.T
    left, size, _ = np.linalg.svd(lost.T, full_matrices=False)
    return np.concatenate([basis, left[:, size > 1e-9]], axis=1)


def build_indexes(docs: DataFrame, blocks: list[list[tuple[object, np.ndarray]]], settings: Settings, text: str = "text") -> list[Index]:
    """The latent spaces of blocks of passages (item, word hashes) among all documents."""
    if not blocks:
        return []
    every = np.unique(np.concatenate([w for cut in blocks for _, w in cut]))
    held, n = document_frequencies(docs, every, text)
    spaces, items = [], []
    for cut in blocks:
        vocabulary = np.unique(np.concatenate([w for _, w in cut]))
        idf = np.log((n + 1) / (held[np.searchsorted(every, vocabulary)] + 1)) + 0.05
        omega = np.random.default_rng(settings.seed).normal(size=(len(vocabulary), min(settings.rank + 16, len(vocabulary))))
        x = np.zeros((len(cut), len(vocabulary)))
        for k, (_, w) in enumerate(cut):
            np.add.at(x[k], _terms(vocabulary, w), idf[_terms(vocabulary, w)])
        spaces.append((vocabulary, idf, omega))
        items.append(x)
    return [_index(cut, space, x, spread, energy, settings) for cut, space, x, (spread, energy) in zip(blocks, spaces, items, corpus_range(docs, spaces, settings, text), strict=True)]


def _index(cut: list[tuple[object, np.ndarray]], space: tuple, x: np.ndarray, spread: np.ndarray, energy: float, settings: Settings) -> Index:
    vocabulary, idf, omega = space
    own = x.T @ (x @ omega)
    weight = settings.item_weight * energy / max((x**2).sum(), 1e-12) if energy else 1.0
    left, _, _ = np.linalg.svd(spread + weight * own, full_matrices=False)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    basis = with_lost_directions(left[:, : settings.rank], unit, settings.min_energy)
    latent = unit @ basis
    passages = []
    for i, w in cut:
        masks: dict[int, int] = {}
        for k, h in enumerate(w.tolist()):
            masks[h] = masks.get(h, 0) | 1 << k
        rare = np.argsort(-idf[_terms(vocabulary, w)], kind="stable")[: max(3, len(w) // 4)]
        mine, counts = np.unique(_terms(vocabulary, w), return_counts=True)
        passages.append(Passage(i, w, masks, np.unique(w[rare]), mine, counts))
    # the product of projections is linear in the words: (x V)(V' b) = sum over words of idf * V V' b
    scores = (idf[:, None] * basis) @ latent.T
    return Index(settings, vocabulary, idf, scores.astype(np.float32), passages)


def common_subsequence(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps over ``other``."""
    full = (1 << length) - 1
    v = full
    for h in other:
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def best_leaks(indexes: list[Index], row: np.ndarray, h: np.ndarray, rows: int) -> list[tuple]:
    """(row, item, cosine, lcs, answer, first_word, last_word): the best place of each item in each row, over all indexes."""
    found: dict[tuple, tuple] = {}
    for index in indexes:
        for r, item, *value in leaks_in(index, row, h, rows):
            if (r, item) not in found or _better(value, found[r, item]):
                found[r, item] = value
    return [(*key, *value) for key, value in found.items()]


def _better(a: tuple, b: tuple) -> bool:
    """By subsequence, answer and place; by cosine if these are the same."""
    return tuple(a[1:]) > tuple(b[1:]) or (tuple(a[1:]) == tuple(b[1:]) and a[0] > b[0])


def leaks_in(index: Index, row: np.ndarray, h: np.ndarray, rows: int) -> list[tuple]:
    """:func:`best_leaks` of one index."""
    s = index.settings
    windows = Windows(row, rows, s.window)
    term = index.terms(h)
    ok = term >= 0
    product = windows.sums(windows.step[ok], index.scores, term[ok])
    energy = windows.add_next(np.bincount(windows.step[ok], index.idf[term[ok]] ** 2, minlength=windows.n))
    found: dict[tuple, tuple] = {}
    norm = np.sqrt(np.maximum(energy, 1e-12)).astype(np.float32)
    for at in range(0, windows.n, 8192):
        cosine = product[at : at + 8192] / norm[at : at + 8192, None]
        for k, p in zip(*np.nonzero(cosine >= s.min_cosine), strict=True):
            passage = index.passages[p]
            r = windows.row[at + k]
            a, b = windows.span(at + k)
            m = len(passage.words)
            lo, hi = max(0, a - m), min(int(windows.counts[r]), b + m)
            at_words = slice(windows.first_word[r] + lo, windows.first_word[r] + hi)
            # words in common, order aside, bound the subsequence from above
            here = term[at_words]
            place = np.minimum(np.searchsorted(passage.own, here), len(passage.own) - 1)
            common = np.minimum(np.bincount(place[passage.own[place] == here], minlength=len(passage.own)), passage.counts).sum()
            if common < s.min_lcs * m:
                continue
            region = h[at_words]
            lcs = common_subsequence(passage.masks, m, region.tolist()) / m
            if lcs < s.min_lcs:
                continue
            answer = float(np.isin(passage.answer, region).mean())
            if lcs < s.sure_lcs and answer < s.min_answer:
                continue
            key = (int(r), passage.item)
            value = (float(cosine[k, p]), lcs, answer, lo, hi)
            if key not in found or _better(value, found[key]):
                found[key] = value
    return [(*key, *value) for key, value in found.items()]


def _blocks(benchmark: DataFrame, item_id: str, text: str, settings: Settings) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The benchmark's passages block by block; only one block is on the driver."""
    block, items = [], 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        passages = item_passages(text_words([r[1]])[0], settings)
        if block and (items == settings.block_items or len(block) + len(passages) > settings.rank):
            yield block
            block, items = [], 0
        items += 1
        for part in passages:
            if len(block) == settings.rank:
                yield block
                block = []
            block.append((r[0], part))
    if block:
        yield block


def indexes(docs: DataFrame, benchmark: DataFrame, settings: Settings, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Iterator[list[Index]]:
    """The indexes of all blocks, as many at once as one scan takes."""
    group = []
    for block in _blocks(benchmark, item_id, item_text, settings):
        group.append(block)
        if len(group) == settings.scan_blocks:
            yield build_indexes(docs, group, settings, text)
            group = []
    if group:
        yield build_indexes(docs, group, settings, text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word, last_word of every benchmark item found in every document."""
    settings = settings or Settings()
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer double, first_word long, last_word long"
    out = spark.createDataFrame([], schema)
    for group in indexes(docs, benchmark, settings, text, item_id, item_text):
        shared = spark.sparkContext.broadcast(group)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(source):
                found = [(i + r, *rest) for i, j, row, h in _word_runs(batch.column(1)) for r, *rest in best_leaks(shared.value, row, h, j - i)]
                if found:
                    row, item, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), *(pa.array(c) for c in rest)], names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "last_word"])

        out = out.unionByName(docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for group in indexes(docs, benchmark, settings or Settings(), text, item_id, item_text):
        shared = spark.sparkContext.broadcast(group)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(source):
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, j, row, h in _word_runs(batch.column(at)):
                    clean[[i + r for index in shared.value for r, *_ in leaks_in(index, row, h, j - i)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
