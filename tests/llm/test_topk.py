import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import topk


def _brute(rows, k):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(r, i, [math.floor(64 * x) for x in v]) for r, (i, v) in enumerate(usable)]
    out = []
    for r, i, q in ints:
        if i is None or i % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), math.inf if j is None else j) for s, j, v in ints if s != r and len(v) == len(q))[:k]
        out += [(i, n + 1, None if j == math.inf else j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out, key=str)


def _run(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, row int, d int, score string")
    return sorted((tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 20 == 0, **options).collect()), key=str)


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # one very common vector
    rows += [(2000, None), (2020, [None] + [0.0] * 7), (2040, [float("nan")] + [0.0] * 7), (2060, [float("inf")] + [0.0] * 7), (2080, [])]
    rows += [(None, rows[7][1]), (None, None), (40, rows[5][1]), (40, rows[40][1]), (41, rows[40][1])]
    rows += [(i, [float(i % 7), 1.0]) for i in range(0, 60, 5)]  # vectors of another length meet each other
    want = _brute(rows, 20)
    assert _run(spark, rows, k=20, head=3) == want
    assert _run(spark, rows, k=20, head=3, block=16, cell_queries=7, cell_candidates=50) == want


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0]), (20, [1.0]), (1, [1.0]), (2, [0.5])]
    assert _run(spark, rows, k=3) == _brute(rows, 3)
    assert [r for r in _run(spark, rows, k=3)][0] == (20, 1, 1, 4096)


@pytest.mark.parametrize("big", [2**27 + 1, 2**29 + 3, 3])
def test_large_integers_are_exact(spark, big):
    rng = np.random.default_rng(1)
    rows = [(i, [float(big + int(x)) / 64 for x in rng.integers(-2, 3, 4)]) for i in range(0, 100, 5)]
    assert _run(spark, rows, "double", k=4, head=2) == _brute(rows, 4)


def test_vectors_whose_products_do_not_fit_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1e30, 1.0]), (3, [2.0, 2.0])]
    assert _run(spark, rows, "double", k=4) == _brute([rows[0], rows[2]], 4)


def test_falling_lengths_end_the_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) * (2.0 if i < 40 else 0.01) for x in rng.normal(0, 1, 6)]) for i in range(400)]
    assert _run(spark, rows, k=5, head=2, block=8, cell_candidates=60, cell_queries=4) == _brute(rows, 5)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.5])]
    assert _run(spark, rows, k=5) == [(0, 1, 1, -4096)]
    assert _run(spark, [], k=5) == []
