"""The registered queries against their SQL, and against brute force on a small folder of tables where SQL cannot state them."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.test_jaccard_join import _brute
from tests.test_queries import _plain
from tomewright.llm import decontaminate, language_id, packing, queries

SF = f"{DATA}/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    cursor = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(got.columns)
    want = sorted(tuple(map(_plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    path = str(tmp_path_factory.mktemp("tables"))
    words = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["zsch", "ung", "ver", "heit", "qu"]}
    say = lambda lang, n: " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(n))
    items = [(k, say("aa", 40)) for k in range(6)] + [(100, None), (101, "")]
    rows = [(i, say("aa" if i % 2 else "bb", rng.randint(3, 300)), "aa" if i % 2 else "bb", "s", 0) for i in range(90)]
    rows += [(90 + k, f"{say('bb', 30)} {text} {say('aa', 30)}", None, "s", 0) for k, text in items[:6]]
    rows += [(96 + k, f"{say('bb', 30)}\n{' '.join(w for i, w in enumerate(text.split()) if i % 7)} {say('aa', 30)}", None, None, 0) for k, text in items[:6]]
    rows += [(110, None, "aa", "s", 0), (111, "", None, "s", 0), (112, "12 !", "bb", "s", 0), (113, rows[4][1], "aa", "s", 0), (114, say("aa", 9000), "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}, dict(items)


def _trigrams(text):
    runs = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    return [f" {w} "[i : i + 3] for w in runs for i in range(len(w)) if len(f" {w} "[i : i + 3].strip()) > 1]


def test_language_of_every_document(spark, folder):
    path, rows, _ = folder
    got = {r.doc_id: r for r in queries.op1_language_id(spark, path).collect()}
    assert set(got) == set(rows)
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    counts = {lang: Counter(g for i, t, la, *_ in rows.values() if la == lang and i not in held for g in _trigrams(t)) for lang in ("aa", "bb")}
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    sets = {lang: {g for g, s in share[lang].items() if s >= 2e-5 and s >= 0.1 * max(share[x].get(g, 0) for x in share)} for lang in share}
    learnt = language_id.train(spark.read.parquet(f"{path}/documents.parquet").where(f"doc_id not in ({','.join(map(str, held))})"))
    assert learnt.languages == ["aa", "bb"]
    for i, (_, text, *_) in rows.items():
        grams = _trigrams(text)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        rates = {lang: sum(g in sets[lang] for g in grams) / len(grams) for lang in sets}
        best = max(sorted(rates), key=rates.get)
        assert got[i].lang_pred == best and abs(got[i].score - rates[best]) < 5e-3  # what the filters let through by chance


def test_tokens_of_every_line(spark, folder):
    import public_tokenizers

    from tomewright.llm import tokens

    path, rows, _ = folder
    encoder, _ = tokens.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = {}
    for r in queries.op3_token_counts(spark, path).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(rows)
    for i, (_, text, *_) in rows.items():
        text = text or ""
        mine = sorted(found[i], key=lambda r: r.section)
        assert sum(r.n_tokens for r in mine) == len(encoder.encode_ordinary(text)) == mine[0].doc_tokens
        assert [text[r.start : r.end] for r in mine] == (text.splitlines(keepends=True) or [""])


def test_components_of_documents(spark, folder):
    path, rows, _ = folder
    got = sorted((tuple(r)[:3] for r in queries.op7_ngram_jaccard(spark, path).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == _brute([(i, t) for i, t, *_ in rows.values()], 4, 85)


def test_packed_pieces(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rows, _ = folder
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = queries.op8_bin_completion_packing(spark, path)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    pieces, sequences = {}, {}
    for r in out.collect():
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, (_, text, *_) in rows.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, p] = (at, len(part), zlib.crc32(part.tobytes()))
    assert pieces == want
    for placed in sequences.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends
            ends += length
        assert ends <= 4096
    assert len(sequences) == packing.lower_bound([n for _, n, _ in want.values()], 4096)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_leaks_from_six_tenths_on(spark, folder):
    path, rows, items = folder
    got = {(r.doc_id, r.item_id): r for r in queries.op9_benchmark_decontamination(spark, path).collect()}
    settings = decontaminate.Settings()
    want = set()
    for i, (_, text, *_) in rows.items():
        for k, item in items.items():
            if not (text or "").strip() or not (item or "").strip():
                continue
            a, b = item.split(), text.split()
            span = 2 * len(a) + settings.window  # as far as the operator reads round a passage
            share = max(_lcs(a, b[s : s + span]) for s in range(0, max(1, len(b)), span // 2)) / len(a)
            if share >= settings.sure_lcs:
                want.add((i, k))
    assert {(90 + k, k) for k in range(6)} | {(96 + k, k) for k in range(6)} <= want
    assert want <= set(got)
    for (i, k), r in got.items():
        assert r.lcs >= settings.min_lcs and _lcs(items[k].split(), rows[i][1].split()) / len(items[k].split()) >= r.lcs - 1e-9
