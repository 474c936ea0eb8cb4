import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tomewright.llm import language_model as lm


def _rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            at = (at + rng.choice([1, 1, 1, 7])) % 60
            text.append(words[at])
        rows.append((i, " ".join(text), i % 5 == 0))
    return [*rows, (100, None, False), (101, "", True), (102, "unseen W1 w1 " * 3000, True), (None, "W1", True), (102, "W1", True)]


def test_scores_equal_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held boolean, score string")
    got = lm.fit_and_score(df.select("doc_id", "text", "held"), "not held", ["doc_id", "held"], shortlist=20, dim=8).collect()
    assert len(got) == len(rows)
    token = lambda t: (t or "").lower().split() + [""]
    c = Counter(w for _, t, held in rows if not held for w in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(w := token(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for _, t, _ in rows)
    assert want == sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    inside = [r for r in got if r.doc_id is not None and r.doc_id < 80 and r.n_tokens > 5]
    assert sum(r.score for r in inside) > sum(r.base_score for r in inside)  # context helps here


def test_every_context_is_normalised():
    rng = np.random.default_rng(1)
    p = lm.Parameters(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((12, 4), (12, 4), (12,), (2, 4))))
    t = lm.tables(p, block=5)
    logs = t.near[:, None, :] + t.far[None, :, :] + t.bias - t.norm[:, :, None]
    assert np.allclose(np.exp(logs.astype(float)).sum(-1), 1, atol=1e-4)
    direct = (p.r[3] * p.c[0] + p.r[7] * p.c[1]) @ p.q.T + p.b
    assert np.allclose(logs[3, 7], direct - np.log(np.exp(direct).sum()), atol=1e-4)


def test_rare_words_share_their_slot(spark):
    counts = spark.createDataFrame([(i, 100 - i) for i in range(1, 50)] + [(int(lm.END), 7)], "h long, c long")
    vocab = lm.vocabulary(counts, shortlist=10, known=20)
    assert len(vocab.hashes) <= 20 and vocab.n == sum(100 - i for i in range(1, 50)) + 7 and vocab.v == 50 and vocab.slot_counts[vocab.end] == 7
    rare = [100 - i for i in range(11, 50)]
    assert vocab.rare_mass == sum(x + 1 for x in rare) + 1


def test_without_training_text(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")
    got = lm.fit_and_score(df, "not held", ["doc_id"], shortlist=5, dim=2).collect()
    assert got[0].train_tokens == 0 and got[0].n_known == 0 and got[0].n_tokens == 3
    assert got[0].base_score == 0 and math.isfinite(got[0].score)
    assert lm.fit_and_score(df.limit(0), "not held", ["doc_id"], shortlist=5, dim=2).count() == 0


def test_a_small_task_learns_all_its_texts_as_often(spark):
    """Two texts alike but for their words, in one task and too long for one run."""
    texts = [" ".join([f"{a}{'o' * 30}", f"{a}{'e' * 30}", f"{a}{'u' * 30}"] * 7_000) for a in "xy"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = lm.count_words(df)
    vocab = lm.vocabulary(counts, shortlist=6)
    t = lm.tables(lm.train(df, vocab, dim=8))
    slots = [vocab.look_up(next(lm._tokens(pa.array([x[:400]])))[3][:3])[0] for x in texts]
    x, y = (float(t.near[b, c] + t.far[a, c] + t.bias[c] - t.norm[b, a]) for a, b, c in slots)
    assert abs(x - y) < 0.1 and min(x, y) > -0.5
