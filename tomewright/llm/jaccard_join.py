"""Exact n-gram Jaccard join with count-vector R-trees, and the components of its links.

A text's set is its distinct word n-grams (64-bit hashes). Tokens of a set are hashed into groups; the counts of the
groups are a point, and the overlap of two sets is at most the sum of their points' coordinate minima. R-trees over the
points find the pairs this bound leaves; those are verified on the sets themselves.

One tree over all points would not prune: with hundreds of near-independent coordinates every region meets every query.
So a directory routes points to many small trees, losing no link. Two sets of sizes a <= b link only if they differ in
at most d = floor((a + b)(100 - t) / (100 + t)) n-grams. For a band of sizes, the hash space is cut into d + 1 + s
ranges: linked sets agree on the whole content of at least 1 + s ranges. Each (band, range, content) is a shard. An
empty range is content like any other, but only sets with more than s empty ranges need its shard; so linked sets always
share a shard. A set goes to the bands its own and its largest partner's size lie in.

Shard keys and points are stored once, an array a text, and the keys joined slice by slice of the key space, so one
slice's shuffle is on disk at a time. Of shards with the same members one stays. A round of stars then meets each member
with its shard's best connected member and verifies what the bound leaves, which joins what is alike in linear work.
N-grams are read again from the texts, of those sets only that have something to verify. Only shards that still hold several components
are searched, a shard's sets standing in one cell: trees over the points name the sets that the bound leaves a partner
in another component; only those bring their n-grams to the cell, where the pairs the bound leaves are verified at once
and links join components as the search goes on, so a cell returns fewer links than it has components. A shard of more than
``cell`` sets is cut by a second key before, a gram among the rarest of the shard that every linked pair must share
(prefix filter: of n n-grams, the n - ceil(t n) + 1 rarest); what is still larger is met block by block. Exact copies
count once, by their set's hash.

Cases: null, empty and wordless texts have size 0, link with nothing and are their own component; a text with fewer
words than n has its whole sequence as one n-gram; repeated rows are exact copies; a null id never names a component
unless all its members' ids are null; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .workspace import Scratch, batches, bit_filter, in_filter, row_slices, text_buffers
from .words import mix

_U = np.uint64
CHUNK = 1 << 20
#: Keys of a slice at least; the number of slices has a bound of its own.
SLICE_KEYS = 2_000_000


def _loose(items: int, ranges: int, spare: int) -> float:
    """Chance that over ``spare`` of ``ranges`` ranges stay empty under ``items`` hashes."""
    if items <= 64:  # exact: how many ranges are occupied after each hash
        filled = np.zeros(ranges + 1)
        filled[0] = 1
        share = np.arange(ranges + 1) / ranges
        for _ in range(items):
            moved = filled * (1 - share)
            filled = filled * share
            filled[1:] += moved[:-1]
        return float(filled[: max(0, ranges - spare)].sum())
    mean = ranges * (1 - 1 / ranges) ** items  # near Poisson, whose upper tail is below the normal bound used here
    return 0.0 if spare >= mean + 3 * math.sqrt(mean) + 1 else 1.0


@lru_cache(maxsize=64)
def _bands(percent: int, count: int, ratio: float = 0.7) -> list[tuple[int, int, int]]:
    out, low = [], 1
    for _ in range(count):
        high = max(low + 1, int(low / ratio))
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        least = -(-percent * low // 100)
        spare = 0
        while _loose(least, differ + 1 + spare, spare) >= 2e-3 and spare < 2 * differ + 3:
            spare += max(1, spare // 8)
        ranges = differ + 1 + spare
        out.append((low, ranges, spare))
        low = high
    return out


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, ranges, spare) of each band of sizes, up to one that begins beyond ``largest``."""
    count = 16
    while _bands(percent, count)[-1][0] <= largest:
        count *= 2
    return _bands(percent, count)


def _sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of consecutive rows, and offsets of the rows in them."""
    rows = len(offsets) - 1
    _, _, row, word = words.scan(raw, offsets)
    grams, owner = words.shingles(word, row, rows, width)
    order = np.argsort(owner, kind="stable")
    grams, owner = grams[order], owner[order]
    at = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[at[1:]] - total[at[:-1]]


def shard_keys(grams: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard keys of every row's set, with the row of each key."""
    sizes = np.diff(at)
    scheme = bands(percent, int(100 * sizes.max(initial=1) // percent))
    lows = np.array([b[0] for b in scheme])
    own = np.searchsorted(lows, sizes, side="right") - 1
    upto = np.searchsorted(lows, 100 * sizes // percent, side="right") - 1
    content = mix(grams ^ _U(0x5851F42D4C957F2D))
    keys, owners = [], []
    for k in np.unique(np.concatenate([own[sizes > 0], upto[sizes > 0]])):
        rows = np.flatnonzero((sizes > 0) & (own <= k) & (upto >= k))
        _, ranges, spare = scheme[k]
        inside = np.repeat(np.arange(len(rows)), sizes[rows])
        take = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]), sizes[rows]) + np.arange(len(inside))
        part = (((grams[take] >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)  # rising within a row
        cell = inside * ranges + part
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        total = _sums(content[take], np.append(begins, len(cell)))
        cells = cell[begins]
        row, piece = np.divmod(cells, ranges)
        filled = np.bincount(row, minlength=len(rows))
        loose = np.flatnonzero(ranges - filled > spare)
        if len(loose):
            have = np.zeros((len(loose), ranges), dtype=bool)
            where = np.full(len(rows), -1)
            where[loose] = np.arange(len(loose))
            mine = where[row] >= 0
            have[where[row[mine]], piece[mine]] = True
            r, p = np.nonzero(~have)
            row, piece, total = np.concatenate([row, loose[r]]), np.concatenate([piece, p]), np.concatenate([total, np.zeros(len(r), _U)])
        keys.append(mix(total + _U(int(k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + piece.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
        owners.append(rows[row])
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def point_width(size: int) -> int:
    """Coordinates of a set's point: about one for each n-gram, a power of two from 16 to 4096."""
    return min(4096, max(16, 1 << max(0, int(size) - 1).bit_length()))


def count_point(grams: np.ndarray) -> bytes:
    """Counts of the groups that n-grams hash into, in the narrowest integers that hold them, after a byte that names these."""
    width = point_width(len(grams))
    counts = np.bincount(((grams * _U(0xD1342543DE82EF95)) >> _U(52)).astype(np.int64) & (width - 1), minlength=width)
    kind = np.min_scalar_type(int(counts.max()))
    return str(kind.itemsize).encode() + counts.astype(kind).tobytes()


def fold(points: list[bytes]) -> np.ndarray:
    """Points of any widths as rows of the least width among them: groups are summed, which keeps the bound valid."""
    read = [np.frombuffer(p, f"<u{p[:1].decode()}", offset=1) for p in points]
    width = min(map(len, read))
    return np.stack([p.reshape(-1, width).sum(0, dtype=np.int32) for p in read])


class RTree:
    """A bulk-loaded tree over count points: leaves of close points, nodes with coordinate maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 32):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        high, least = self.points[rows].max(0), int(self.sizes[rows].min())
        if len(rows) <= self.leaf:
            return high, least, rows, ()
        spread = self.points[rows].var(0)
        axis = int(spread.argmax())
        order = rows[np.argsort(self.points[rows, axis], kind="stable")]
        half = len(order) // 2
        return high, least, None, (self._build(order[:half]), self._build(order[half:]))

    def pairs(self, percent: int, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of different parts whose summed coordinate minima can reach the overlap that a link needs."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if np.minimum(a[0], b[0]).sum() * (100 + percent) < percent * (a[1] + b[1]):
                continue
            if a[2] is not None and b[2] is not None:
                yield from self._meet(a[2], b[2], a is b, percent, part)
            elif a is b:
                x, y = a[3]
                stack += [(x, x), (x, y), (y, y)]
            elif b[2] is not None or (a[2] is None and len(a[3]) and a[1] <= b[1]):
                stack += [(x, b) for x in a[3]]
            else:
                stack += [(a, y) for y in b[3]]

    def _meet(self, left: np.ndarray, right: np.ndarray, same: bool, percent: int, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        apart = part[left][:, None] != part[right][None, :]
        if same:
            apart &= left[:, None] < right[None, :]
        total = self.sizes[left][:, None] + self.sizes[right][None, :]
        apart &= np.minimum(self.sizes[left][:, None], self.sizes[right][None, :]) * (100 + percent) >= percent * total
        i, j = np.nonzero(apart)
        for k in range(0, len(i), 4096):
            x, y = left[i[k : k + 4096]], right[j[k : k + 4096]]
            bound = np.minimum(self.points[x], self.points[y]).sum(1)
            ok = bound * (100 + percent) >= percent * (self.sizes[x] + self.sizes[y])
            if ok.any():
                yield x[ok], y[ok]


def _runs(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, n-grams, their offsets, set hashes) of stretches of a batch of (any, text)."""
    raw, offsets = text_buffers(batch.column(1))
    for i, j in row_slices(offsets, CHUNK):
        grams, at = _sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        yield i, j, grams, at, mix(_sums(mix(grams), at) + np.diff(at).astype(_U)).view(np.int64)


def _lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _keyed(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, point, keys): size and hash of every text's set, its point and its shard keys."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for i, j, grams, at, fp in _runs(batch, width):
                key, row = shard_keys(grams, at, percent)
                order = np.argsort(row, kind="stable")
                points = [count_point(grams[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(fp), pa.array(points, pa.binary()), _lists(np.searchsorted(row[order], np.arange(j - i + 1)), key[order])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp", "point", "keys"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n long, fp long, point binary, keys array<long>")


def _sets_of(docs: DataFrame, doc_id: str, text: str, width: int, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, n, grams) of the sets ``wanted`` (fp), one row each; read from one text of each, picked by a filter on ids."""
    spark = docs.sparkSession
    one = members.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    shared = spark.sparkContext.broadcast(bit_filter(one.select(F.xxhash64("doc_id").alias("k")), "k"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches(source):
            batch = batch.filter(pa.array(in_filter(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            for _, _, grams, at, fp in _runs(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.diff(at), pa.int64()), _lists(at, grams)], names=["fp", "n", "grams"])

    scanned = docs.select(F.xxhash64(doc_id).alias("k"), F.col(text)).mapInArrow(run, "fp long, n long, grams array<long>")
    return scanned.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))


def _shards(keyed: DataFrame, scratch: Scratch, slices: int) -> DataFrame:
    """(key, fp) of the shards that hold two or more different sets; of shards with equal members the one of least key."""
    total = keyed.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
    slices = max(1, min(slices, total // SLICE_KEYS))  # a small table is not cut as often
    found = []
    for k in range(slices):
        mine = keyed.select("fp", F.explode("keys").alias("key")).where(F.pmod(F.shiftright("key", 40), F.lit(slices)) == k)
        # copies of a set combine in their task: a key has one row a task here, and all its rows are split in the join
        several = scratch.keep(mine.groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("key"), "several")
        found.append(scratch.keep(mine.join(several, "key", "left_semi").groupBy("key", "fp").agg(F.count("*").alias("copies")).select("key", "fp"), f"hits{k}"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    shards = scratch.keep(_once(hits), "shards")
    scratch.drop("several", *(f"hits{k}" for k in range(slices)))
    return shards


def _once(shards: DataFrame) -> DataFrame:
    """Of shards with the same members only that of the least key."""
    # two hashes combined by xor, and the number, name the members of a shard
    named = shards.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("s"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("t"))
    once = named.groupBy("m", "s", "t").agg(F.min("key").alias("key"))
    return shards.join(once.select("key"), "key", "left_semi")


def _stars(shards: DataFrame) -> DataFrame:
    """(a, b): every member of a shard with the shard's best connected member."""
    degree = shards.groupBy("fp").agg(F.count("*").alias("degree"))
    centre = shards.join(degree, "fp").groupBy("key").agg(F.max(F.struct("degree", "fp")).alias("m")).select("key", F.col("m.fp").alias("centre"))
    return shards.join(centre, "key").where("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima can reach the overlap that a link needs."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, (total, p, q) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                x, y = fold([p, q])
                ok[i] = np.minimum(x, y).sum() * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    a = points.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p"))
    b = points.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("q"))
    total = F.col("n_a") + F.col("n_b")
    sized = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * (100 + percent) >= percent * total)
    return sized.select("a", "b", total.alias("total"), "p", "q").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set hashes that link: the overlap of the sets themselves decides."""
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    common = F.size(F.array_intersect("g_a", "g_b"))
    return pairs.join(b, "b").join(a, "a").where(common * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def links_in_cell(part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (part, part) that join the parts of a cell wherever two of their sets link; fewer than there are parts.

    The tree names the pairs of sets whose bound reaches the overlap a link needs; they are verified by marking one
    set's n-grams and counting the marks in the others. Sets whose parts are joined already are not met again.
    """
    names, label = np.unique(part, return_inverse=True)
    if len(names) == 1:
        return []
    own = label.copy()
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(grams), dtype=bool)
    out = []
    for x, y in RTree(fold([count_point(s) for s in sets]), sizes).pairs(percent, label):  # label changes as the search goes on
        begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for a, b in zip(begins, [*begins[1:], len(x)], strict=True):
            u, others = x[a], y[a:b]
            others = others[label[others] != label[u]]
            if not len(others):
                continue
            mark[ids[at[u] : at[u + 1]]] = True
            first = np.cumsum(sizes[others]) - sizes[others]
            within = np.repeat(at[others] - first, sizes[others]) + np.arange(sizes[others].sum())
            common = np.add.reduceat(mark[ids[within]].astype(np.int64), first)
            mark[ids[at[u] : at[u + 1]]] = False
            for w in others[common * (100 + percent) >= percent * (sizes[u] + sizes[others])]:
                if label[w] != label[u]:
                    out.append((int(names[own[u]]), int(names[own[w]])))
                    label[label == label[w]] = label[u]
    return out


def with_partners(part: np.ndarray, sizes: np.ndarray, points: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a cell the bound leaves a partner of another part."""
    left = np.zeros(len(part), dtype=bool)
    if (part != part[0]).any():
        for x, y in RTree(fold(points), sizes).pairs(percent, part):
            left[x] = left[y] = True
    return left


def _by_cell(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(cell, rows) of a stream sorted by its first three columns; rows hold the others, arrays as numpy."""
    cell, rows = None, []
    for batch in batches(source):
        columns = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for name, *row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
            if name != cell:
                if rows:
                    yield cell, rows
                cell, rows = name, []
            rows.append(tuple(x.values.to_numpy().view(_U).copy() if isinstance(x, pa.ListScalar) else x for x in row))
    if rows:
        yield cell, rows


def _dealt(cells: DataFrame, *columns: str) -> DataFrame:
    """Rows of a cell stand together in a partition and are read as a stream, so only one cell is in memory."""
    keys = ["key", "lo", "hi"]
    return cells.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)


def _surviving(cells: DataFrame, percent: int) -> DataFrame:
    """The rows (key, lo, hi, fp, part) of cells that the bound leaves a partner; cells: key, lo, hi, fp, part, n, point."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for cell, rows in _by_cell(source):
            fp, part, sizes, points = zip(*rows, strict=True)
            left = with_partners(np.array(part), np.array(sizes), list(points), percent)
            out += [(*cell, fp[i], part[i]) for i in np.flatnonzero(left)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "lo", "hi", "fp", "part"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "lo", "hi", "fp", "part"])

    return _dealt(cells, "fp", "part", "n", "point").mapInArrow(run, "key long, lo long, hi long, fp long, part long")


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between parts from every cell; cells: key, lo, hi, part, grams."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_cell(source):
            parts, sets = zip(*rows, strict=True)
            if found := links_in_cell(np.array(parts), list(sets), percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return _dealt(cells, "part", "grams").mapInArrow(run, "a long, b long").distinct()


def _split(parted: DataFrame) -> DataFrame:
    """(key, m) of the shards that hold several parts, with their number of sets."""
    return parted.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("m")).where("x <> y").select("key", "m")


def _finer(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, fp, part) of large shards under second keys: linked sets of a shard share one at least.

    Both hold one of their n - ceil(t n) + 1 n-grams that are rarest in the shard, whatever else they share, so text
    that all members have in common brings none of them together.
    """
    grams = large.join(sets, "fp").select("key", "fp", "part", "n", F.explode("grams").alias("gram"))
    common = grams.groupBy("key", "gram").agg(F.count("*").alias("held"))
    order = Window.partitionBy("key", "fp").orderBy("held", "gram")
    ranked = grams.join(common, ["key", "gram"]).withColumn("place", F.row_number().over(order))
    rare = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return rare.select(F.xxhash64("key", "gram").alias("key"), "fp", "part")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", cell: int = 2048, slices: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of ``width`` words. ``doc_id`` may be of
    any type that has an order, a struct too.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.keep(_keyed(docs, doc_id, text, width, percent), "keyed", "lz4")
    members = scratch.keep(keyed.select("doc_id", "n", "fp"), "members")
    shards = _shards(keyed, scratch, slices)
    held = shards.select("fp").distinct()
    points = scratch.keep(keyed.select("fp", "n", "point").join(held, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("point").alias("point")), "points")
    scratch.drop("keyed")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        return scratch.keep(_sets_of(docs, doc_id, text, width, members, wanted.distinct()), name, "lz4")

    stars = scratch.keep(_bounded(_stars(shards), points, percent), "stars")
    sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("fp")), "sets")
    labels = connected_components(scratch.keep(_verified(stars, sets, percent), "links"))
    parted = shards.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("part"))
    parted = scratch.keep(parted, "parted")
    scratch.drop("shards", "stars", "sets")

    # shards that still hold several parts grow R-trees, the large ones after a finer cut
    split = scratch.keep(_split(parted), "split")
    placed = parted.join(split.where(F.col("m") <= cell), "key").select("key", "fp", "part", "m")
    large = parted.join(split.where(F.col("m") > cell).select("key"), "key", "left_semi")
    if not large.isEmpty():
        finer = scratch.keep(_finer(large, sets_of(large.select("fp"), "sets"), percent), "finer")
        finer = scratch.keep(_once(finer.join(_split(finer), "key")).select("key", "fp", "part", "m"), "finer")
        placed = placed.unionByName(finer)
        scratch.drop("sets")
    blocks = F.ceil(F.col("m") / cell)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("each", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = placed.select("key", F.least("own", "each").alias("lo"), F.greatest("own", "each").alias("hi"), "fp", "part")
    left = scratch.keep(_surviving(cells.join(points, "fp"), percent), "left")
    scratch.drop("points")
    sets = sets_of(left.select("fp"), "sets")
    joined = connected_components(scratch.keep(_cell_links(left.join(sets.select("fp", "grams"), "fp"), percent), "joined"))

    wider = parted.select("fp", "part").distinct().join(joined.withColumnRenamed("node", "part").withColumnRenamed("label", "whole"), "part", "left").select("fp", F.coalesce("whole", "part").alias("label"))
    named = members.join(wider, "fp", "left").select("doc_id", "n", F.coalesce("label", "fp").alias("part"))
    named = scratch.keep(named, "named")
    scratch.drop("members", "sets", "links", "parted", "split", "finer", "left", "joined")
    # a table of its own, so that the join below can split a component that holds very many rows
    first = scratch.keep(named.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("first_id")), "first")
    linked = named.where("n > 0").join(first, "part").select("doc_id", "n", "first_id")
    alone = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("first_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"))
