import numpy as np
import public_tokenizers
import pytest

from tomewright.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_add_up_and_match_a_plain_walk(spark):
    texts = ["one two\n\n  three\nfour", None, "", "日本語テスト🙂\nzz", "a\n" * 40_000, "no line end", "no line end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "body")
    out = tokens.section_tokens(df, ["doc_id"], PATH, public_tokenizers.PATTERN, "body").collect()
    encoder, _ = tokens.byte_encoder(PATH, public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        t = t or ""
        ids = encoder.encode_ordinary(t)
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in mine) == len(ids) == mine[0].doc_tokens
        assert "".join(t[r.start : r.end] for r in mine) == t
        if len(t) > 1000:
            continue
        want, at = [0] * len(mine), 0
        for token in ids:
            raw = encoder.decode_single_token_bytes(token)
            first = len(t.encode()[:at].decode("utf-8", "ignore"))
            at += len(raw)
            last = next(n for n in range(first, len(t) + 1) if len(t[:n].encode()) >= at)
            held = [max(0, min(r.end, last) - max(r.start, first)) for r in mine]
            want[int(np.argmax(held))] += 1
        assert want == [r.n_tokens for r in mine]


@pytest.mark.parametrize("span,section", [((0, 4), 0), ((2, 9), 1), ((3, 7), 0), ((4, 12), 1)])
def test_boundary_rule(span, section):
    # sections 0-5 and 5-12: a token goes where most of it is, to the earlier one on a tie
    got, crosses = tokens.attribute(np.array([span[0]]), np.array([span[1]]), np.array([0, 5]), 12)
    assert got[0] == section
    assert crosses[0] == (span[0] < 5 < span[1])


def test_empty_table(spark):
    assert tokens.section_tokens(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], PATH, public_tokenizers.PATTERN).count() == 0
