import random

import numpy as np

from tomewright.llm import jaccard_join as jj


def _set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _brute(rows, width, percent):
    sets = [_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    first = {g: min((rows[i][0] for i in members if rows[i][0] is not None), default=None) for g, members in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), first[find(i)]) for i in range(len(rows))), key=str)


def _rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows = []
    for n in (1, 2, 3, 4, 5, 6, 8, 11, 20, 45, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base))
            for edits in (0, 1, 1, 2, 4, n // 20, n // 12, n // 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                rows.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 1])] or base))
    chain = [word() for _ in range(200)]  # each links to the next only
    for k in range(12):
        rows.append(" ".join(chain))
        for _ in range(4):
            chain[rng.randrange(200)] = word()
    shared = " ".join(word() for _ in range(60))
    rows += [f"{shared} {' '.join(word() for _ in range(40))}" for _ in range(30)]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return [*rows, (None, None), (5001, ""), (5002, " \n"), (7, "Lone Word"), (7, "lone\tword"), (None, "lone word"), (None, "only null id here of these words")]


def test_components_equal_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, fp int").repartition(3)
    for width, percent, cell in ((4, 85, 2048), (5, 80, 3)):
        got = sorted((tuple(r) for r in jj.near_duplicates(df, width, percent, cell=cell).collect()), key=str)
        assert got == _brute(rows, width, percent)


def test_empty_table(spark):
    assert jj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_shard():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for size in (1, 2, 5, 9, 30, 77, 300, 2500):
            for _ in range(20):
                a = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
                keep = -(-percent * size // 100)
                for b in (a[:keep], np.concatenate([a[: -(-2 * percent * size // (100 + percent))], rng.integers(0, 2**63, size, dtype=np.uint64)])[:size]):
                    both = [np.unique(a), np.unique(b)]
                    n = len(np.intersect1d(*both))
                    if 100 * n < percent * (len(both[0]) + len(both[1]) - n):
                        continue
                    keys, row = jj.shard_keys(np.concatenate(both), np.array([0, len(both[0]), len(both[0]) + len(both[1])]), percent)
                    assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)])) for _ in range(150)]
    sizes, part = np.array([len(s) for s in sets]), rng.integers(0, 4, 150)
    tree = jj.RTree(jj.fold([jj.count_point(s) for s in sets]), sizes, leaf=8)
    found = {tuple(sorted(p)) for x, y in tree.pairs(85, part) for p in zip(x.tolist(), y.tolist())}
    for i in range(150):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if part[i] != part[j] and 100 * n >= 85 * (sizes[i] + sizes[j] - n):
                assert (j, i) in found


def test_counts_of_any_size_keep_the_bound():
    rng = np.random.default_rng(2)
    huge = rng.integers(0, 2**63, 400_000, dtype=np.uint64)
    for sets in ([huge, huge[:390_000]], [huge[:40], huge[:38], huge[5:90]], [np.repeat(huge[:1], 70_000), np.repeat(huge[:1], 70_000)]):
        points = jj.fold([jj.count_point(s) for s in sets])
        assert [int(p.sum()) for p in points] == [len(s) for s in sets]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert np.minimum(points[i], points[j]).sum() >= len(np.intersect1d(a, b))


def test_a_cell_returns_fewer_links_than_parts():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.concatenate([base[:85], rng.integers(0, 2**63, 25, dtype=np.uint64)])) for _ in range(50)]
    links = jj.links_in_cell(np.arange(350), sets, 85)
    assert len(links) == 299 and max(max(p) for p in links) < 300
    left = jj.with_partners(np.arange(350), np.array([len(s) for s in sets]), [jj.count_point(s) for s in sets], 85)
    assert left[:300].all()
