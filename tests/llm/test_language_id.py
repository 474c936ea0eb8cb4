import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tomewright.llm import language_id
from tomewright.llm.workspace import held_out

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["zsch", "ung", "ver", "heit"]}


def _docs(n=80, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(30)), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=n))]


def test_held_out_languages_are_found(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", held_out(F.col("doc_id"), 4, 2))
    model = language_id.train(docs.where("not held"))
    got = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id", "held"]).collect()}
    assert {i for i in got if got[i].held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)


def test_nulls_empty_letterless_and_clashing_columns(spark):
    rows = [(1, None, "aa", "x"), (2, "", None, "x"), (3, "123 !?", "aa", None), (None, "katomi katomi", "aa", "y"), (4, "kato " * 50_000, "aa", "z"), (4, "kato " * 50_000, "aa", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train(docs)
    out = language_id.predict(docs.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "aa", "aa", "aa"]
    assert all(r.score == 0 for r in out if r.lang_pred == "und")


def test_no_training_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert [r.lang_pred for r in language_id.predict(docs, model, ["doc_id"]).collect()] == ["und"]
    assert language_id.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_filter_holds_all_languages_of_an_ngram(spark):
    docs = spark.createDataFrame([(1, "shared only", "aa"), (2, "shared other", "bb")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    rates = language_id.hit_rates(model, *__import__("tomewright.llm.workspace", fromlist=["x"]).text_buffers(__import__("pyarrow").array(["shared"])))[0]
    assert rates[0].min() > 0.9


def test_long_rows_come_in_pieces_with_the_same_trigrams(monkeypatch):
    texts = ["Ab  cd-é 12中文字 x " * 40, "abcdefg" * 60, "   ", " a", "", "é" * 301 + " " * 90 + "z"]
    raw, offsets = language_id.text_buffers(pa.array(texts))
    keys, row, letters = language_id._trigrams(raw, offsets)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language_id, "CHUNK", size)
        for i in range(len(texts)):
            pieces = list(language_id._long_trigrams(raw[offsets[i] : offsets[i + 1]]))
            got = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in pieces)])
            assert sorted(got.tolist()) == sorted(keys[row == i].tolist())
            assert sum(n for _, n in pieces) == letters[i]
