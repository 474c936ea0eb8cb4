import random

import numpy as np

from tomewright.llm import decontaminate as dc


def _world(seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "to", "is", "that"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefghijklmno", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 59)))) for i in range(30)]
    docs, leaks = [], set()
    for i in range(250):
        body = [word() for _ in range(rng.randint(5, 400))]
        if i % 5 == 0:
            k, text = items[rng.randrange(30)]
            passage = text.upper().replace(" ", ",\n ").split()
            if i % 10 == 0:  # a paraphrase: some words changed, one left out
                for _ in range(len(passage) // 9):
                    passage[rng.randrange(len(passage))] = word()
                del passage[len(passage) // 2]
            at = rng.randint(0, len(body))
            body[at:at] = passage
            leaks.add((i, k))
        docs.append((i, " ".join(body)))
    return docs, items, leaks


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    docs, items, leaks = _world()
    extra = [(900, None), (901, ""), (902, "..."), (None, items[3][1]), (903, items[4][1]), (903, items[4][1]), (904, "zz " * 60_000 + items[5][1])]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs + extra], "doc_id long, text string, item_id string, cosine double").repartition(3)
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_leaks(df, bench).collect()), key=str)
    assert got == sorted([*leaks, (None, 3), (903, 4), (903, 4), (904, 5)], key=str)
    kept = dc.remove_leaks(df, bench)
    assert kept.columns == df.columns
    dirty = {i for i, _ in leaks} | {None, 903, 904}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs + extra if i not in dirty)


def test_blocks_of_items_give_the_same(spark):
    docs, items, leaks = _world(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench, dc.Settings(block_items=7)).collect()}
    assert len(got & leaks) >= 0.9 * len(leaks) and got <= leaks


def test_scans_of_several_blocks_give_the_same(spark):
    docs, items, leaks = _world(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, dc.find_leaks(df, bench, dc.Settings(block_items=7, scan_blocks=n)).collect())) for n in (1, 2, 9)]
    assert got[0] == got[1] == got[2] and len({(d, i) for d, i, *_ in got[0]} & leaks) >= 0.9 * len(leaks)
    long = spark.createDataFrame([(1, " ".join(t for _, t in items))], "item_id long, text string")  # one item in several blocks
    whole = spark.createDataFrame([(1, " ".join(t for _, t in items)), (2, docs[1][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(whole, long, dc.Settings(rank=8, scan_blocks=8)).collect()] == [(1, 1)]


def test_recall_of_the_candidate_search(spark):
    """Against a subsequence check of every item with every document."""
    docs, items, _ = _world(6)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    settings = dc.Settings(min_lcs=0.6, min_answer=0.0)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench, settings).collect()}
    words, want = dc.text_words([t for _, t in docs]), set()
    for k, w in zip([i for i, _ in items], dc.text_words([t for _, t in items])):
        masks = {}
        for j, h in enumerate(w.tolist()):
            masks[h] = masks.get(h, 0) | 1 << j
        for (d, _), body in zip(docs, words):
            step = max(1, len(w) // 2)
            if any(dc.common_subsequence(masks, len(w), body[a : a + len(w) + 4].tolist()) >= 0.75 * len(w) for a in range(0, max(1, len(body)), max(1, step // 4))):
                want.add((d, k))
    assert len(want) > 20 and len(got & want) >= 0.9 * len(want)


def test_long_items_are_found(spark):
    """Verbatim copies of items of several hundred words, in number of passages beyond the rank."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijklmno", k=3))
    items = [(i, " ".join(word() for _ in range(rng.choice([300, 500])))) for i in range(20)]
    items.append((20, " ".join(word() for _ in range(2000))))  # more passages than the rank
    docs = [(i, " ".join([*(word() for _ in range(i % 3 * 50)), text])) for i, text in items]
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(100)]
    docs += [(200 + i, " ".join(items[i][1].split()[70:134])) for i in range(20)]  # a passage of an item alone
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(df, bench, dc.Settings(rank=48)).collect()}
    want = {(i, i) for i in range(21)} | {(200 + i, i) for i in range(20)}
    assert want <= got and not any(100 <= d < 200 for d, _ in got)


def test_blocks_are_filled_by_passages(spark):
    bench = spark.createDataFrame([(i, "a b c " * n) for i, n in enumerate([100, 100, 1, 1, 1, 400, 1])], "item_id long, text string")
    settings = dc.Settings(rank=16, block_items=3)
    blocks = list(dc._blocks(bench, "item_id", "text", settings))
    assert [list(dict.fromkeys(i for i, _ in b)) for b in blocks] == [[0], [1, 2, 3], [4], [5], [5], [5, 6]]
    assert all(len(b) <= 16 for b in blocks)
    assert [sum(i == 5 for i, _ in b) for b in blocks[3:]] == [16, 16, 5]


def test_every_passage_keeps_its_energy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 90))
    x /= np.linalg.norm(x, axis=1)[:, None]
    basis = dc.with_lost_directions(np.linalg.qr(rng.normal(size=(90, 12)))[0], x, 0.9)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-9)
    assert (((x @ basis) ** 2).sum(1) >= 0.9).all()


def test_the_space_is_fitted_on_all_documents(spark, monkeypatch):
    """Far more documents than tasks, most of them copies: the sum is that of every passage."""
    calls, real = [], dc.corpus_range
    monkeypatch.setattr(dc, "corpus_range", lambda *a, **k: calls.append((a, real(*a, **k))) or calls[-1][1])
    texts = ["a b b c", "c d e f", "a f g", "b d g g g"]
    kinds = [0 if i % 3 == 0 else 1 + i % 3 if i % 5 else 1 for i in range(60_000)]
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(kinds)], "doc_id long, text string")
    words = dc.text_words(["a b c d e f g", "g f e"])
    index, _ = dc.build_indexes(docs, [[(1, words[0])], [(2, words[1])]], dc.Settings())
    (_, ((vocabulary, idf, omega), _), *_), ((got, _), _) = calls[0]
    x = np.zeros((len(texts), len(vocabulary)))
    for k, w in enumerate(dc.text_words(texts)):
        np.add.at(x[k], index.terms(w), idf[index.terms(w)])
    want = x.T @ (np.bincount(kinds)[:, None] * (x @ omega))
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3 * np.abs(want).max())


def test_a_task_sends_its_matrix_in_rows(spark, monkeypatch):
    """Not an element a row of the shuffle: what is on disk grows with the number of tasks."""
    frames, real = [], dc.collected
    monkeypatch.setattr(dc, "collected", lambda df: frames.append(df) or real(df))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plain plan shows its counts
    try:
        docs, items, _ = _world()
        cut = list(zip(range(30), dc.text_words([t for _, t in items])))
        (index,) = dc.build_indexes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), [cut], dc.Settings())
        plan, written = [frames[-1]._jdf.queryExecution().executedPlan()], []
        for node in plan:
            plan += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange" and node.metrics().contains("shuffleBytesWritten"):
                written.append(node.metrics().apply("shuffleBytesWritten").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # besides the matrix, the exchange that deals out the documents counts here
    texts = 2 * sum(len(t) for _, t in docs)
    assert 0 < sum(written) < 3 * (len(index.vocabulary) + 1) * 272 * 5 + texts


def test_empty_sides(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.find_leaks(docs.limit(0), bench).count() == 0
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.remove_leaks(docs, bench.limit(0)).count() == 1


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 15).tolist()
        table = [[0] * 16 for _ in range(13)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert dc.common_subsequence(masks, 12, b) == table[12][15]
