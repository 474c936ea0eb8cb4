"""Log-bilinear language model trained with noise-contrastive estimation, and its token log-probabilities.

The model predicts the slot of a token from the slots of the two before it: r = c1 * r[w-1] + c2 * r[w-2] (one weight
vector a position), score = r . q[w] + b[w]. Slots are the most frequent ``shortlist`` words, the end of a text, and one
slot for all other words, inside which a word has its smoothed count's share; so every token has a probability and each
context's probabilities add up to one.

Counting covers all training texts and its words are summed by hash in shuffles. Training is local noise-contrastive
descent in every task over all its tokens, from one start, and the tasks' parameters are averaged by weight; what tasks
send grows with the input, what the driver holds is one parameter set. Normalisers: a context is a pair of slots, so all
of them are one table, made by batched matrix products; scoring a token is then a look-up. Counts of words beyond the
``known`` most frequent (a broadcast of fixed size) are joined by hash.

Cases: null and empty texts are one end token; repeated rows teach and are scored each; without training text the model
is uniform over its slots and counts are 0; extra columns stay out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .workspace import batches, collected, row_slices, text_buffers, written

CHUNK = 1 << 20
#: The hash under which the end of a text is counted; no word is empty, so no word has it by construction of hashing.
END = np.int64(-0x2545F4914F6CDD1D)
LOG10E = 1 / np.log(10)


@dataclass
class Vocabulary:
    """``hashes`` sorted, ``counts`` along; ``slot`` is the word's slot or ``rare``."""

    hashes: np.ndarray
    counts: np.ndarray
    slot: np.ndarray
    slot_counts: np.ndarray
    n: int
    v: int
    rare: int
    end: int
    rare_mass: float

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and count of each word; count -1 where the word is not among those kept."""
        if not len(self.hashes):
            return np.full(len(hashes), self.rare), np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return np.where(found, self.slot[at], self.rare), np.where(found, self.counts[at], -1)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first, last, row of each word, hash of each word)."""
    raw, offsets = text_buffers(column)
    for i, j in row_slices(offsets, CHUNK):
        _, _, row, h = words.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, row, h.view(np.int64)


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): how often each word of all texts occurs; the end of a text counts as a word. Summed per task first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            parts = [h for *_, h in _tokens(batch.column(0))]
            h, c = np.unique(np.concatenate([*parts, np.full(batch.num_rows, END)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h, "c": c.astype(np.int64)})

    return texts.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, shortlist: int = 1022, known: int = 1 << 17) -> Vocabulary:
    """The most frequent words, at most ``known`` and all of one count or none, with slots for the first ``shortlist``, and the corpus totals."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    # the least count that at most ``known`` words reach: a histogram of counts decides, not a sort of all words
    tally = counts.groupBy("c").agg(F.count("*").alias("words"))
    upto = tally.select("c", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c"))).alias("upto"))
    least = upto.where(F.col("upto") <= known).agg(F.min("c").alias("c")).collect()[0]["c"]
    top = collected(counts.where((F.col("c") >= (least if least is not None else 1 << 62)) | (F.col("h") == int(END))))
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    h, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    is_end = h == END
    ends = int(c[is_end].sum())
    h, c = h[~is_end], c[~is_end]
    rare, end = shortlist, shortlist + 1
    slot = np.full(len(h), rare)
    slot[:shortlist] = np.arange(min(shortlist, len(h)))
    slot_counts = np.zeros(shortlist + 2)
    slot_counts[: min(shortlist, len(h))] = c[:shortlist]
    slot_counts[end] = ends
    slot_counts[rare] = total["n"] - slot_counts.sum()
    rare_words = total["v"] - min(shortlist, len(h)) - (1 if ends else 0)
    order = np.argsort(h)
    # every rare word has its count and one, and one more stands for all words never seen
    return Vocabulary(h[order], c[order], slot[order], slot_counts, int(total["n"]), int(total["v"]), rare, end, float(slot_counts[rare] + rare_words + 1))


@dataclass
class Parameters:
    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray  # one row of weights a context position

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)]).astype(np.float32)

    @staticmethod
    def from_flat(x: np.ndarray, slots: int, dim: int) -> Parameters:
        a, b = slots * dim, 2 * slots * dim
        return Parameters(x[:a].reshape(slots, dim).copy(), x[a:b].reshape(slots, dim).copy(), x[b : b + slots].copy(), x[b + slots :].reshape(2, dim).copy())


def start(vocab: Vocabulary, dim: int, seed: int = 1) -> Parameters:
    """Small random vectors, biases at the slots' log frequencies: the model begins as the slots' unigram model."""
    rng = np.random.default_rng(seed)
    slots = len(vocab.slot_counts)
    p = (vocab.slot_counts + 1) / (vocab.slot_counts.sum() + slots)
    return Parameters(rng.normal(0, 0.1, (slots, dim)).astype(np.float32), rng.normal(0, 0.1, (slots, dim)).astype(np.float32), np.log(p).astype(np.float32), np.full((2, dim), 0.5, np.float32))


class Trainer:
    """Noise-contrastive estimation with Adagrad; noise is the slots' unigram distribution, shared by a batch."""

    def __init__(self, at: Parameters, slot_counts: np.ndarray, noise: int = 96, rate: float = 0.15, batch: int = 2048, seed: int = 7):
        self.p, self.noise, self.rate, self.batch = at, noise, rate, batch
        self.rng = np.random.default_rng(seed)
        share = (slot_counts + 1) / (slot_counts.sum() + len(slot_counts))
        self.log_share = np.log(share).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.squares = [np.full_like(x, 1e-2) for x in (at.r, at.q, at.b, at.c)]
        self.seen = 0

    def _step(self, k: int, index: np.ndarray | None, gradient: np.ndarray) -> None:
        x, s = (self.p.r, self.p.q, self.p.b, self.p.c)[k], self.squares[k]
        if index is None:
            s += gradient**2
            x += self.rate * gradient / np.sqrt(s)
        else:
            s[index] += gradient**2
            x[index] += self.rate * gradient / np.sqrt(s[index])

    def _gathered(self, index: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients summed by slot."""
        order = np.argsort(index, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], index[order][1:] != index[order][:-1]]))
        return index[order][begins], np.add.reduceat(gradient[order], begins, axis=0)

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """One pass over tokens ``target`` after contexts ``one`` (nearest) and ``two``."""
        for i in range(0, len(target), self.batch):
            c1, c2, w = one[i : i + self.batch], two[i : i + self.batch], target[i : i + self.batch]
            noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), len(self.log_share) - 1)
            r1, r2 = self.p.r[c1], self.p.r[c2]
            context = r1 * self.p.c[0] + r2 * self.p.c[1]
            q_w, q_n = self.p.q[w], self.p.q[noise]
            scale = np.float32(1 / len(w))
            # log-odds that a token is data and not one of the noise tokens
            true = np.einsum("ij,ij->i", context, q_w) + self.p.b[w] - self.log_share[w] - np.float32(np.log(self.noise))
            false = context @ q_n.T + (self.p.b[noise] - self.log_share[noise] - np.float32(np.log(self.noise)))
            g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))
            g_false = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
            d_context = g_true[:, None] * q_w + g_false @ q_n
            d_c = np.stack([(d_context * r1).sum(0), (d_context * r2).sum(0)]) * scale
            index, d_r = self._gathered(np.concatenate([c1, c2]), np.concatenate([d_context * self.p.c[0], d_context * self.p.c[1]]))
            w_index, d_w = self._gathered(np.concatenate([w, noise]), np.concatenate([np.column_stack([g_true[:, None] * context, g_true]), np.column_stack([g_false.T @ context, g_false.sum(0)])]))
            self._step(0, index, d_r * scale)
            self._step(1, w_index, d_w[:, :-1] * scale)
            self._step(2, w_index, d_w[:, -1] * scale)
            self._step(3, None, d_c)
            self.seen += len(w)


def _contexts(vocab: Vocabulary, row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """(row, slot, nearest, next, count) of all tokens with ends; before a text stand two ends."""
    slot, count = vocab.look_up(h)
    at = np.searchsorted(row, np.arange(1, rows + 1))  # the end goes after each row's last word
    row = np.insert(row, at, np.arange(rows))
    slot, count = np.insert(slot, at, vocab.end), np.insert(count, at, int(vocab.slot_counts[vocab.end]))
    one, two = np.full(len(slot), vocab.end), np.full(len(slot), vocab.end)
    one[1:] = np.where(row[1:] == row[:-1], slot[:-1], vocab.end)
    two[2:] = np.where(row[2:] == row[:-2], slot[:-2], vocab.end)
    return row, slot, one, two, count


def _learn(trainer: Trainer, runs: Iterator[tuple[np.ndarray, ...]], least: int) -> int:
    """Train on all runs, and on all of them again until ``least`` tokens are seen; returns the tokens of one pass."""
    kept = []  # all runs so far, while they are few enough to be needed again
    for run in runs:
        trainer.train(*run)
        kept.append(run)
        if trainer.seen >= least:
            kept.clear()
    tokens = trainer.seen
    while kept and trainer.seen < least:
        for run in kept:
            trainer.train(*run)
    return tokens


def train(texts: DataFrame, vocab: Vocabulary, dim: int = 24, rounds: int = 1, text: str = "text", least_steps: int = 400) -> Parameters:
    """Rounds of local training over all texts, parameters averaged by tokens after each.

    A task with few tokens goes over all of them again until it has made ``least_steps`` steps. Each task learns by itself
    with a seed of its own, so the parameters depend, a little, on how texts are dealt to tasks.
    """
    spark = texts.sparkSession
    at, slots = start(vocab, dim), len(vocab.slot_counts)
    shared_vocab = spark.sparkContext.broadcast(vocab)
    for step in range(rounds):
        shared = spark.sparkContext.broadcast(at.flat())

        def run(source: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            v = shared_vocab.value
            trainer = Trainer(Parameters.from_flat(shared.value, slots, dim), v.slot_counts, seed=1 + 1000 * step + TaskContext.get().partitionId())

            def runs() -> Iterator[tuple[np.ndarray, ...]]:
                for batch in batches(source):
                    for i, j, row, h in _tokens(batch.column(0)):
                        _, w, one, two, _ = _contexts(v, row, h, j - i)
                        order = np.random.default_rng(len(w)).permutation(len(w))
                        yield one[order], two[order], w[order]

            tokens = _learn(trainer, runs(), least_steps * trainer.batch)
            if not tokens:
                return
            x = trainer.p.flat().astype(np.float64)
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(x)), "x": x * tokens, "n": np.full(len(x), float(tokens))})

        parts = texts.select(text).mapInArrow(run, "i long, x double, n double")
        mean = collected(parts.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")))
        if len(mean):
            x = np.zeros(len(mean))
            x[mean["i"]] = mean["x"]
            at = Parameters.from_flat(x.astype(np.float32), slots, dim)
    return at


@dataclass
class Tables:
    """log p(w | c1, c2) = near[c1, w] + far[c2, w] + bias[w] - norm[c1, c2], natural logarithms."""

    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    norm: np.ndarray


def tables(p: Parameters, block: int = 64) -> Tables:
    """All contexts' normalisers, by batched matrix products: memory is block * slots**2 numbers at most at a time."""
    near, far = (p.r * p.c[0]) @ p.q.T, (p.r * p.c[1]) @ p.q.T
    slots = len(p.b)
    norm = np.empty((slots, slots), np.float32)
    # exp(a + b + bias) sums over words as a product of two matrices of exponentials
    shift_n, shift_f = near.max(1), far.max(1)
    e_near = np.exp((near - shift_n[:, None]) + p.b)
    e_far = np.exp(far - shift_f[:, None])
    for i in range(0, slots, block):
        norm[i : i + block] = np.log(e_near[i : i + block] @ e_far.T) + shift_n[i : i + block, None] + shift_f[None, :]
    return Tables(near.astype(np.float32), far.astype(np.float32), p.b.astype(np.float32), norm)


def score(docs: DataFrame, vocab: Vocabulary, model: Tables, counts: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """``id_cols`` with n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    base_score adds log10((c + 1) / (N + V + 1)); score is the model's. Words beyond the vocabulary kept are sent once
    per text to a join with ``counts``; a text's own figures travel as a row of their own key, which no other row has.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))
    picked = docs.select(*id_cols, F.col(text).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        base_unit = np.log10(v.n + v.v + 1)
        rid = TaskContext.get().partitionId() << 36
        for batch in batches(source):
            ids = batch.columns[:-1]
            for i, j, row, h in _tokens(batch.column(batch.num_columns - 1)):
                rows = j - i
                word_row = row
                row, w, one, two, count = _contexts(v, row, h, rows)
                logs = (m.near[one, w] + m.far[two, w] + m.bias[w] - m.norm[one, two]).astype(np.float64) * LOG10E
                held = count >= 0
                seen = np.where(held, np.log10(np.maximum(count, 0) + 1), 0.0)
                inside = w == v.rare
                n_tokens = np.bincount(row, minlength=rows)
                base = np.bincount(row, seen, minlength=rows) - n_tokens * base_unit
                total = np.bincount(row, logs + np.where(inside, seen - np.log10(v.rare_mass), 0.0), minlength=rows)
                known = np.bincount(row[held & (count > 0)], minlength=rows)
                slot, c = v.look_up(h)
                lost = c < 0
                pair = np.stack([word_row[lost], h[lost]])
                order = np.lexsort(pair[::-1])
                pair = pair[:, order]
                begins = np.flatnonzero(np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])) if pair.shape[1] else np.zeros(0, np.int64)
                times = np.diff(np.append(begins, pair.shape[1]))
                lost_row, lost_h = pair[0, begins], pair[1, begins]
                key = words.mix((np.arange(rows) + rid).astype(np.uint64)).view(np.int64)
                n_lost = len(begins)
                none_i, none_f = pa.nulls(n_lost, pa.int64()), pa.nulls(n_lost, pa.float64())

                def col(values: np.ndarray, kind: pa.DataType, empty: pa.Array) -> pa.Array:
                    return pa.concat_arrays([pa.array(values, kind), empty])

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.arange(rows), lost_row]) + rid), pa.array(np.concatenate([key, lost_h])), pa.array(np.concatenate([np.zeros(rows, np.int64), times])),
                        *(pa.concat_arrays([x.slice(i, rows), pa.nulls(n_lost, x.type)]) for x in ids),
                        col(n_tokens, pa.int64(), none_i), col(known, pa.int64(), none_i), col(base, pa.float64(), none_f), col(total, pa.float64(), none_f),
                    ],
                    names=["rid", "h", "times", *batch.schema.names[:-1], "n_tokens", "n_known", "base", "total"],
                )
                rid += rows

    rows = picked.mapInArrow(run, ", ".join(["rid long, h long, times long", *kinds, "n_tokens long, n_known long, base double, total double"]))
    met = rows.join(counts.select("h", "c"), "h", "left")
    extra = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)
    found = F.when((F.col("times") > 0) & (F.coalesce("c", F.lit(0)) > 0), F.col("times")).otherwise(0)
    summed = met.groupBy("rid").agg(
        *(F.max(F.when(F.col("times") == 0, F.col(f"`{f.name}`"))).alias(f.name) for f in picked.schema.fields[:-1]),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(found)).alias("n_known"),
        (F.max("base") + F.sum(extra)).alias("base_score"),
        (F.max("total") + F.sum(extra)).alias("score"),
    )
    return summed.select(*(f"`{f.name}`" for f in picked.schema.fields[:-1]), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")


def fit_and_score(docs: DataFrame, is_training: str, id_cols: list[str], text: str = "text", shortlist: int = 1022, dim: int = 24) -> DataFrame:
    """Learn from the rows that ``is_training`` (SQL) selects and score every row."""
    training = docs.where(is_training)
    counts = written(count_words(training, text), "word-counts")
    vocab = vocabulary(counts, shortlist)
    return score(docs, vocab, tables(train(training, vocab, dim, text=text)), counts, id_cols, text)
