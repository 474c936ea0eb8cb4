"""Language identification with bit-sliced Bloom filters of character trigrams.

Training counts the trigrams of every labelled text (exact 63-bit keys, summed in the JVM). A language's filter takes
the trigrams that make up at least ``min_share`` of its own and at least ``min_ratio`` of the share they have in the
language where they are most common. The share bounds the filter: at most 1/min_share trigrams for each language, so
what is broadcast does not grow with the corpus. All filters are one table whose slot is a bit mask of languages; the
AND of a trigram's slots gives every language that may contain it. A text's popcount for a language, less the hits its
filter's fill lets through by chance, decides.

Cases: a null or letterless text is ``und`` with score 0; ties go to the language first in sort order; rows with a null
language or text teach nothing; with no labelled text at all everything is ``und``; a text whose letters make no
trigram (single letters) gets the first language at score 0; repeated rows and extra columns pass through untouched. A
text longer than ``CHUNK`` bytes is read piece by piece, so memory is bounded whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import batches, collected, row_slices, text_buffers
from .words import mix

_U = np.uint64
CHUNK = 1 << 20
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """``slots[i]`` holds a word of language bits; ``fill`` is each language's share of set slots."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray
    probes: int = 4
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point → its lower-case form if it is a letter, else 0."""
    if not _LETTER:
        table = np.zeros(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTER.append(table)
    return _LETTER[0]


def _codes(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a.astype(_U) << _U(42)) | (b.astype(_U) << _U(21)) | c.astype(_U)


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the letter trigrams of each row, their row, and each row's number of letters.

    A run of other characters counts as one blank; a trigram has at least two letters.
    """
    codes = _codes(raw)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    rows = len(offsets) - 1
    letter = _letters()[codes]
    row = np.repeat(np.arange(rows), np.diff(starts))
    n_letters = np.bincount(row[letter > 0], minlength=rows)
    blank = letter == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays
    letter, row = letter[keep], row[keep]
    # a blank before and after each row
    at = np.searchsorted(row, np.arange(rows + 1))
    letter = np.insert(letter, at, 0)
    row = np.insert(row, at, np.concatenate([np.arange(rows), [max(rows - 1, 0)]]))
    if len(letter) < 3:
        return np.zeros(0, _U), np.zeros(0, np.int64), n_letters
    a, b, c = letter[:-2], letter[1:-1], letter[2:]
    ok = (b > 0) & ((a > 0) | (c > 0)) & ((row[:-2] == row[2:]) | (c == 0))
    return _keys(a[ok], b[ok], c[ok]), row[1:-1][ok], n_letters


def _long_trigrams(raw: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Trigram keys and number of letters of one row, piece by piece: together what :func:`_trigrams` gives."""
    last = np.zeros(1, np.uint32)  # the blank before the row, then the last two symbols of the piece before
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        letter = _letters()[_codes(raw[at:end])]
        symbols = np.concatenate([last, letter, np.zeros(int(end == len(raw)), np.uint32)])
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        keep[0] = True
        symbols = symbols[keep]
        a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
        ok = (b > 0) & ((a > 0) | (c > 0))
        yield _keys(a[ok], b[ok], c[ok]), int(np.count_nonzero(letter))
        last, at = symbols[-2:], end


def _stretches(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, keys, row of each, letters) of bounded stretches; a long row comes in several."""
    for i, j in row_slices(offsets, CHUNK):
        part = raw[offsets[i] : offsets[j]]
        if len(part) > CHUNK:  # one row
            for keys, letters in _long_trigrams(part):
                yield i, j, keys, np.zeros(len(keys), np.int64), np.array([letters])
        else:
            yield i, j, *_trigrams(part, offsets[i : j + 1] - offsets[i])


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows whose language and text are known; counted in each batch before the shuffle."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            raw, offsets = text_buffers(batch.column(1))
            codes, names = pd.factorize(batch.column(0).to_pandas(), sort=True)
            keys, langs, counts = [], [], []
            for i, j, key, row, _ in _stretches(raw, offsets):
                which = codes[i:j][row]
                for k in np.unique(which):
                    u, n = np.unique(key[which == k], return_counts=True)
                    keys.append(u), counts.append(n), langs.append(np.full(len(u), k))
            if not keys:
                continue
            frame = pd.DataFrame({"k": np.concatenate(langs), "gram": np.concatenate(keys).view(np.int64), "n": np.concatenate(counts)})
            frame = frame.groupby(["k", "gram"], as_index=False)["n"].sum()
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.asarray(names, dtype=object)[frame["k"]], pa.string()), "gram": pa.array(frame["gram"]), "n": pa.array(frame["n"], pa.int64())})

    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 2e-5, min_ratio: float = 0.1, log2_slots: int = 20, probes: int = 4) -> LanguageModel:
    """Fit the filters on every labelled row of ``docs``; at most 1/min_share trigrams a language reach the driver."""
    counts = trigram_counts(docs, text, lang)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    # a share below min_share elsewhere cannot raise the maximum above what is kept here times 1/min_ratio
    kept = collected(shares)
    languages = sorted(kept["lang"].unique().tolist())
    size, words = 1 << log2_slots, max(1, -(-len(languages) // 64))
    slots = np.zeros((size, words), dtype=_U)
    if languages:
        best = kept.groupby("gram")["share"].transform("max")
        kept = kept[kept["share"] >= min_ratio * best]
        for i, name in enumerate(languages):
            grams = kept.loc[kept["lang"] == name, "gram"].to_numpy(np.int64).view(_U)
            for at in _probes(grams, probes, size):
                slots[at, i // 64] |= _U(1) << _U(i % 64)
    fill = np.array([((slots[:, i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(languages))])
    if len(languages) <= 8:
        slots = slots[:, :1].astype(np.uint8)
    return LanguageModel(languages, slots, fill, probes)


def _probes(keys: np.ndarray, probes: int, size: int) -> Iterator[np.ndarray]:
    h = mix(keys + _U(1))
    step = (h >> _U(32)) | _U(1)
    for k in range(probes):
        yield ((h + _U(k) * step) & _U(size - 1)).astype(np.int64)


def hit_rates(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's corrected hit rate for each language, and its number of letters."""
    rows, n_langs = len(offsets) - 1, len(model.languages)
    hits, total, letters = np.zeros((rows, n_langs)), np.zeros(rows), np.zeros(rows, np.int64)
    for i, j, keys, row, n in _stretches(raw, offsets):
        letters[i:j] += n
        mask = None
        for at in _probes(keys, model.probes, len(model.slots)):
            mask = model.slots[at] if mask is None else mask & model.slots[at]
        total[i:j] += np.bincount(row, minlength=j - i)
        for k in range(n_langs):
            bit = mask.dtype.type(1 << (k % 64))
            hits[i:j, k] += np.bincount(row[(mask[:, k // 64] & bit) != 0], minlength=j - i)
    chance = model.fill**model.probes
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = np.where(total[:, None] > 0, hits / np.maximum(total, 1)[:, None], 0)
        return np.clip((rate - chance) / np.maximum(1 - chance, 1e-9), 0, 1), letters


def _judge(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Position of each text's language (past the last: undetermined) and its score."""
    rates, letters = hit_rates(model, *text_buffers(column))
    if not model.languages:
        return np.zeros(len(column), np.int64), np.zeros(len(column))
    return np.where(letters > 0, rates.argmax(1), len(model.languages)), np.where(letters > 0, rates.max(1), 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_cols: list[str], text: str | Column = "text") -> DataFrame:
    """``id_cols`` with lang_pred and score (the best language's corrected share of the text's trigrams, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches(source):
            best, score = _judge(m, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    picked = docs.select(*id_cols, (F.col(text) if isinstance(text, str) else text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(label, ", ".join([*fields, "lang_pred string", "score double"]))


def keep_determined(docs: DataFrame, model: LanguageModel, least_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with at least ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches(source):
            best, score = _judge(m, batch.column(at))
            yield batch.filter(pa.array((best < len(m.languages)) & (score >= least_score)))

    return docs.mapInArrow(keep, docs.schema)
