"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Vectors are rotated once by the eigenvectors of their Gram matrix (one distributed sum), so the first few coordinates
carry most of every product; those and the length of the rest are stored beside the integers. Candidates are dealt into
bands of falling length. All queries meet the first band; a query goes on only to the bands whose longest vector times
its own length can still reach its k-th score. A cell (a group of queries and a part of a band) walks its candidates by
falling length in the same way: a pair is scored in full only if its partial product plus the product of both rests
(Cauchy-Schwarz) can reach the k-th score. Bounds carry an allowance for rounding; full scores are integers, in float64
where no sum of a block can pass 2**53 and in int64 otherwise, so results are exact. Ties go to the smaller id.

Of equal vectors only the k + 1 smallest ids are candidates: no query's list can hold more of them, its own row apart,
so a vector that very many rows share costs no more than others.

Cases: vectors that are null, empty, hold null or non-finite components, or whose squared integer length passes 2**62 (a
product need not fit a long) take no part. Vectors of different lengths have no product; each meets those of its own
length. Fewer than k candidates give all of them. Repeated ids are rows of their own, as queries (each gives its list)
and as candidates (only the query's own row is left out). A null id is no query; as a candidate it comes after all ids.
An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Scratch, batches, collected

#: Below every score; its negative is an integer too.
NONE = -(1 << 62) - 1
LAST = np.iinfo(np.int64).max
#: What rounding in 32 bits may take from a partial product, as a share of both lengths.
SLACK = 1e-5


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v, d, sq): components as floor(scale * x), their number and squared length, of rows that take part."""
    x = F.col("x")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where(usable & (F.size(x) > 0))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0))) <= float(1 << 62))
    whole = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    return whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("d"), length.alias("sq"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rotation(vectors: DataFrame, vec_col: str) -> np.ndarray:
    """Eigenvectors of the Gram matrix, by falling eigenvalue: the right singular vectors of the whole table."""

    def gram(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches(source):
            m = _matrix(batch.column(0)).astype(np.float64)
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            n = len(total)
            i, j = np.divmod(np.arange(n * n), n)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "g": total.ravel()})

    cells = collected(vectors.select(vec_col).mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")))
    if cells.empty:
        return np.zeros((0, 0))
    n = int(cells["i"].max()) + 1
    g = np.zeros((n, n))
    g[cells["i"], cells["j"]] = cells["g"]
    _, vectors_ = np.linalg.eigh((g + g.T) / 2)
    return np.ascontiguousarray(vectors_[:, ::-1])


def rotated(m: np.ndarray, v: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first coordinates, length of the rest, length) of integer rows; rows of another width than ``v`` stay unrotated."""
    wide = m.astype(np.float64)
    turned = wide @ v if wide.shape[1] == len(v) else wide
    rest = np.sqrt((turned[:, head:] ** 2).sum(1))
    return turned[:, :head].astype(np.float32), rest.astype(np.float32), np.sqrt((wide * wide).sum(1))


class Best:
    """The k best (score, id, row) of each of some queries; smaller ids, then rows, break ties."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), LAST)
        self.rows = np.full((queries, k), LAST)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge pairs, in any order, into the lists of their queries."""
        ok = score >= self.floor()[query]
        query, score, ids, rows = query[ok], score[ok], ids[ok], rows[ok]
        if not len(query):
            return
        k = self.score.shape[1]
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, k)])
        score, ids, rows = (np.concatenate([new, old[touched].ravel()]) for new, old in ((score, self.score), (ids, self.ids), (rows, self.rows)))
        order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        ok = rank < k
        at = query[ok], rank[ok]
        self.score[at], self.ids[at], self.rows[at] = score[ok], ids[ok], rows[ok]


def search(q_rows: np.ndarray, q: np.ndarray, floors: np.ndarray, blocks: list, v: np.ndarray, k: int, head: int) -> Best:
    """Each query's k best among candidate blocks (top, ids, rows, integers, head, rest) sorted by falling length.

    ``floors`` are scores that are known to be reached by k other candidates; only pairs that reach them are wanted.
    """
    q_head, q_rest, q_len = rotated(q, v, head)
    wide = q.astype(np.float64)
    best = Best(len(q), k)
    alive = np.arange(len(q))
    for top, ids, rows, ints, c_head, c_rest in blocks:
        least = np.maximum(best.floor(), floors)
        alive = alive[q_len[alive] * top * (1 + 1e-9) + 1e-6 >= least[alive]]
        if not len(alive):
            break
        bound = q_head[alive] @ c_head.T
        bound += q_rest[alive, None] * c_rest[None, :]
        bound += (SLACK * top * q_len[alive] + 1e-3).astype(np.float32)[:, None]
        hit = bound >= least[alive, None].astype(np.float64) * (1 - np.sign(least[alive, None]) * 1e-6)
        small = float(q_len[alive].max()) * top < 2**53
        if small and hit.mean() > 0.2:
            score = np.rint(wide[alive] @ ints.astype(np.float64).T).astype(np.int64)
            if score.shape[1] > k:  # of a query's pairs only its k best of this block matter, ties included; its own row is one more
                cut = np.partition(score, score.shape[1] - k - 1, axis=1)[:, -k - 1]
                hit &= score >= cut[:, None]
            at, col = np.nonzero(hit)
            score = score[at, col]
        else:
            at, col = np.nonzero(hit)
            if small:
                score = np.rint(np.einsum("ij,ij->i", wide[alive[at]], ints[col].astype(np.float64))).astype(np.int64)
            else:
                score = np.einsum("ij,ij->i", q[alive[at]].astype(np.int64), ints[col].astype(np.int64))
        others = q_rows[alive[at]] != rows[col]
        best.offer(alive[at[others]], score[others], ids[col[others]], rows[col[others]])
    return best


def _packed(m: np.ndarray) -> bytes:
    """Integers in the narrowest of 16, 32 and 64 bits, with a byte that names it."""
    most = int(np.abs(m).max(initial=0))
    kind = next(t for t, limit in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < limit)
    return kind[2].encode() + m.astype(kind).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).reshape(-1, width)


_BLOCK = "d int, sq double, ids binary, rows binary, ints binary, head binary, rest binary"


def _blocks(candidates: DataFrame, v: np.ndarray, head: int, block: int, keys: list[str]) -> DataFrame:
    """Blocks of candidates of one d and the same ``keys``, rotated: a row of bytes for each."""
    shared = candidates.sparkSession.sparkContext.broadcast(v)

    def chunk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        for batch in batches(source):
            *groups, d, sq, ids, rows, _ = (c.to_numpy(zero_copy_only=False) if c.null_count == 0 else None for c in batch.columns)
            column = batch.column(len(keys) + 4)
            own = np.stack([*groups, d])
            edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, b, block):
                    j = min(b, i + block)
                    m = column.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                    front, rest, _ = rotated(m, shared.value, head)
                    out.append((*(int(g[i]) for g in groups), int(d[i]), float(sq[i:j].max()), ids[i:j].astype("<i8").tobytes(), rows[i:j].astype("<i8").tobytes(), _packed(m), front.tobytes(), rest.tobytes()))
            types = [*[pa.int64()] * len(keys), pa.int32(), pa.float64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*keys, *names])

    ordered = candidates.select(*keys, "d", "sq", F.coalesce("vec_id", F.lit(int(LAST))).alias("vec_id"), "row", "v").sortWithinPartitions(*keys, "d", F.desc("sq"))
    return ordered.mapInArrow(chunk, ", ".join([*(f"{k} long" for k in keys), _BLOCK]))


def _meet(v, k: int, head: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "vec_id", "row", "score")})
        if left.empty or right.empty:
            return empty
        q = np.stack(left["v"].to_numpy()).astype(np.int64)
        width = q.shape[1]
        front = min(head, width)
        blocks = (
            (float(np.sqrt(r.sq)), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.rows, "<i8"), _unpacked(r.ints, width), np.frombuffer(r.head, np.float32).reshape(-1, front), np.frombuffer(r.rest, np.float32))
            for r in right.sort_values("sq", ascending=False).itertuples()
        )
        q_rows = left["row"].to_numpy(np.int64)
        best = search(q_rows, q, left["floor"].to_numpy(np.int64), blocks, v.value, k, front)
        at, rank = np.nonzero(best.score > NONE)
        return pd.DataFrame({"query_row": q_rows[at], "vec_id": best.ids[at, rank], "row": best.rows[at, rank], "score": best.score[at, rank]})

    return meet


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, head: int = 24, block: int = 1024, cell_queries: int = 8_192, cell_candidates: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row that ``is_query`` (over vec_id) marks."""
    scratch = Scratch(vectors.sparkSession)
    table = scratch.keep(quantised(vectors, id_col, vec_col, scale), "vectors")
    widths = table.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    v = rotation(table.where(F.col("d") == (widths[0]["d"] if widths else 0)), "v")
    front = min(head, len(v)) if len(v) else head
    shared = table.sparkSession.sparkContext.broadcast(v)

    # of equal vectors no list can hold more than k, besides the query's own row
    alike = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    candidates = scratch.keep(table.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("place"), "candidates")
    asked = is_query & F.col("vec_id").isNotNull()
    n, n_queries = candidates.count(), table.where(asked).count()
    bands = max(1, -(-n // cell_candidates))
    cuts = sorted(set(candidates.agg(F.percentile_approx("sq", [i / bands for i in range(1, bands)], 10_000)).collect()[0][0] or []), reverse=True) if bands > 1 else []
    band = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c > F.col("sq"))).cast("long") if cuts else F.lit(0).cast("long")
    banded = candidates.withColumn("band", band)
    # equal lengths lie in one band; a band of more than a cell's candidates is dealt into parts
    counts = banded.groupBy("band").agg(F.count("*").alias("n"), F.max("sq").alias("top"))
    dealt = banded.join(F.broadcast(counts.select("band", F.ceil(F.col("n") / cell_candidates).alias("parts"))), "band")  # a row a band
    placed = scratch.keep(_blocks(dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))), v, front, block, ["band", "part"]), "placed")
    cells = scratch.keep(placed.groupBy("band", "part", "d").agg(F.max("sq").alias("top")), "cells")

    groups = max(1, -(-n_queries // cell_queries))
    groups *= max(1, min(-(-n_queries // 64), 16 // groups))  # a small table still fills the cluster
    queries = table.where(asked).select("row", "d", "v", "sq", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("r"))

    def met(asking: DataFrame, among: DataFrame, name: str) -> DataFrame:
        """Pairs of queries (row, d, v, sq, r, floor) and the cells that can still reach their floors."""
        reach = F.sqrt(F.col("sq").cast("double")) * F.sqrt("top") * (1 + 1e-9) + 1e-6 >= F.col("floor")
        left = asking.join(F.broadcast(among), "d").where(reach)  # a row a cell of candidates
        needed = scratch.keep(left.select("r", "band", "part", "d").distinct(), name)
        right = placed.join(needed, ["band", "part", "d"])
        keys = ["r", "band", "part", "d"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(shared, k, head), "query_row long, vec_id long, row long, score long")

    first = scratch.keep(_ranked(met(queries.withColumn("floor", F.lit(NONE)), cells.where("band = 0"), "needed"), k).drop("rank"), "first")
    found = first
    if cuts:
        floors = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        going = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        found = first.unionByName(scratch.keep(met(going, cells.where("band > 0"), "needed-more"), "more"))
    names = table.where(asked).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    named = _ranked(found, k).join(names, "query_row")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("vec_id"), F.lit(int(LAST))).alias("vec_id"), "score")
