"""Vectorised word scanning over a text column's UTF-8 bytes.

A word is a longest run of bytes that are not ASCII white space (space, tab to carriage return); A-Z are lowered
first. Words are identified by a 64-bit hash: a polynomial over random byte values, then a finaliser. Two different
words of a corpus meet with probability near 2**-64 a pair, which callers accept as equality.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SEGMENT = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift, invertible)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    width = 1
    while width < n:
        step = _U(pow(base, width, 1 << 64))
        out[width : 2 * width] = out[: min(width, n - width)] * step
        width *= 2
    return out


_BASE = 0x9E3779B97F4A7C15 | 5
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, SEGMENT + 1)
        _TABLES[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _TABLES


def scan(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive rows: (start, end, row, hash), start and end in bytes of ``raw``.

    ``keep`` marks the bytes that belong to words (default: all but white space); rows end words.
    """
    low = LOWER[raw]
    inside = ~WHITE[low] if keep is None else keep[low]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(_U)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row, hashes(low, start, end)


def hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``low``; spans are in order and disjoint. Works in segments of bounded size."""
    out = np.empty(len(start), dtype=_U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + SEGMENT, side="right")))
        stop = int(end[j - 1])
        power, inverse = _tables(stop - base)
        total = np.zeros(stop - base + 1, dtype=_U)
        np.cumsum(_BYTE[low[base:stop]] * power[: stop - base], out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(_U))
        i = j
    return out


_ROLL = [_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3), _U(0x1D8E4E27C47D124F)]


def shingles(word: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words with their row; a row with fewer words gives its whole sequence as one.

    A row without words gives nothing. Runs never cross rows.
    """
    counts = np.bincount(row, minlength=rows)
    n = len(word)
    pieces, owner = [], []
    if n >= width:
        whole = row[: n - width + 1] == row[width - 1 :]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), dtype=_U)
        for k in range(width):
            h += mix(word[at + k] * _ROLL[k % 5] + _U(k))
        pieces.append(mix(h + _U(width)))
        owner.append(row[at])
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        begins = np.concatenate([[0], np.cumsum(counts)])
        h = np.zeros(len(few), dtype=_U)
        for k in range(width - 1):
            has = counts[few] > k
            h[has] += mix(word[begins[few[has]] + k] * _ROLL[k % 5] + _U(k))
        pieces.append(mix(h + counts[few].astype(_U)))
        owner.append(few)
    if not pieces:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(owner)
