import numpy as np
import pyarrow as pa

from tomewright.llm import words
from tomewright.llm.workspace import bit_filter, in_filter, text_buffers

TEXTS = ["The cat", None, "", "  a\tb\x0bc \n", "x" * 50, "É ü É", "the CAT sat the cat"]


def test_words_are_equal_exactly_when_their_hashes_are():
    raw, offsets = text_buffers(pa.array(TEXTS))
    start, end, row, h = words.scan(raw, offsets)
    plain = [(i, w) for i, t in enumerate(TEXTS) for w in (t or "").encode().lower().split()]
    assert [int(r) for r in row] == [i for i, _ in plain]
    seen = {}
    assert all(seen.setdefault(w, int(x)) == int(x) for (_, w), x in zip(plain, h))
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    raw, offsets = text_buffers(pa.array([text]))
    whole = words.scan(raw, offsets)[3]
    monkeypatch.setattr(words, "SEGMENT", 64)
    assert (words.scan(raw, offsets)[3] == whole).all()


def test_shingles_match_a_plain_count():
    raw, offsets = text_buffers(pa.array(TEXTS))
    _, _, row, h = words.scan(raw, offsets)
    for width in (1, 2, 4):
        grams, owner = words.shingles(h, row, len(TEXTS), width)
        want = []
        for i, t in enumerate(TEXTS):
            w = (t or "").encode().lower().split()
            n = len(w) - width + 1 if len(w) >= width else min(len(w), 1)
            want += [i] * n
        assert sorted(owner.tolist()) == want
        assert len(grams) == len(want)


def test_bit_filter_never_loses_a_key(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = bit_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 18)
    assert in_filter(bits, keys).all()
    assert in_filter(bits, rng.integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.05
