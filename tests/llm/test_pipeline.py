import re

import corpus_pipeline
from tests.llm.test_jaccard_join import _brute


def _fixture(spark, folder):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ka", "to", "mi", "ru", "sen"], k=3))
    texts = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(60)]
    item = " ".join(word() for _ in range(30))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " tail") for i in range(10)] + [(200, texts[3]), (200, texts[3]), (201, f"{texts[4][:80]} {item} {texts[5][:80]}")]
    rows += [(300, None), (301, ""), (302, "12 34"), (303, "中文字 " * 20)]
    df = spark.createDataFrame([(i, t, "aa" if i < 300 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (n1, f1), (n2, f2), (n3, f3), (n4, f4) = corpus_pipeline.STAGES
    one = f1(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, t in rows if i < 300)
    two = f2(spark, one, str(tmp_path))
    kept = [(i, t) for i, t in rows if i < 300]
    want = sorted({i for i, _, first in _brute(kept, 5, 80) if i == first})
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == want
    three = f3(spark, two, str(tmp_path))
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == [i for i in want if i != 201]
    four = f4(spark, three, str(tmp_path))
    assert sorted({r.doc_id for r in four.collect()}) == [i for i in want if i != 201]


def test_run_applies_all_stages(spark, tmp_path):
    _fixture(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert re.match(r"language_id", corpus_pipeline.STAGES[0][0])


def _stage(spark, name, rows, tmp_path, schema="doc_id long, text string, lang string, source string, n_chars long"):
    df = spark.createDataFrame([(*r, "aa", "s", 1) for r in rows], schema)
    return dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))


def test_near_duplicates_go_by_row(spark, tmp_path):
    text = [f"{w} one {w} two {w} three four {w}" for w in ("oak", "elm", "ash", "fir", "yew", "box", "may")]
    got = lambda rows: sorted((tuple(r)[:2] for r in _stage(spark, "near_duplicates", rows, tmp_path).collect()), key=str)
    rows = [(5, text[0]), (None, text[0]), (None, text[1]), (3, text[2]), (200, text[2]), (200, text[3])]  # null and repeated ids
    rows += [(None, text[4]), (None, text[4]), (None, None), (None, ""), (1, None), (1, None)]  # no id at all, no text at all
    rows += [(11, text[5]), (11, text[5]), (11, text[6]), (12, text[6])]  # one id, two texts
    kept = [(5, text[0]), (None, text[1]), (3, text[2]), (200, text[3]), (None, text[4]), (None, None), (None, ""), (1, None), (1, None), (11, text[5]), (11, text[6])]
    assert got(rows) == sorted(kept, key=str)
    assert got([]) == []


def test_stages_pass_other_columns_and_empty_tables(spark, tmp_path):
    _fixture(spark, tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, fp int, n int, score double, part string, key string"
    words = "ka to mi ru sen " * 12
    rows = [(1, words, "aa", "s", 1, 2, 3, 0.5, "p", "k"), (None, None, None, None, None, None, None, None, None, None)]
    for rows_, kept in ((rows, [1]), ([], [])):
        docs = spark.createDataFrame(rows_, kinds)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            if name == "language_id":
                assert [r.doc_id for r in out.collect()] == kept
            else:
                assert out.count() == len(rows_)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows_)
