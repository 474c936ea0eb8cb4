import itertools
import random
import zlib

import numpy as np
import public_tokenizers

from tomewright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _least(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [r - sizes[i] if j == k else r for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
        bins = packing.complete(sizes, 60, width=8, depth=4)
        assert sorted(itertools.chain(*bins)) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 60 for b in bins)
        assert len(bins) == _least(sizes, 60) >= packing.lower_bound(sizes, 60)


def test_bin_completion_beats_its_incumbent():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3]  # best fit opens more bins than needed here or as many
    assert len(packing.complete(sizes, 15)) == 3 <= len(packing.best_fit(sizes, 15))


def test_many_bins_do_not_stop_the_search():
    hard = [41, 41, 30, 30, 29, 29]  # two bins; best fit opens three
    assert len(packing.best_fit(hard, 100)) == 3 and len(packing.complete(hard, 100)) == 2
    full = [100] * 4000 + hard
    bins = packing.complete(full, 100)
    assert sorted(itertools.chain(*bins)) == list(range(len(full))) and len(bins) == 4002
    paired = [60, 40] * 3500 + hard  # no piece stands alone
    bins = packing.complete(paired, 100)
    assert sorted(itertools.chain(*bins)) == list(range(len(paired))) and all(sum(paired[i] for i in b) <= 100 for b in bins)
    assert len(bins) < len(packing.best_fit(paired, 100))


def test_ids_are_the_tokenizers(spark):
    texts = ["Don't STOP'S it's ''s 'sword x²y ½ été ÉTÉ Σας ΟΔΟΣ İstanbul", "a\x1cb c", "日本語 テスト", "ß ẞ ª º", "<|endoftext|> hi", " \n "]
    encoder = packing.word_encoder(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_have_their_ids():
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> hi", "it<|endoftext|>'s<|startoftext|>ÉTÉ", "<|endoftext|><|endoftext|>\n日本<|startoftext|>語", "a\x1c<|endoftext|>b", "<|ENDOFTEXT|> <| endoftext|>"]
    fresh = Tokenizer.from_file(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.word_encoder(PATH).encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [343, 49407, 1883]


def test_pieces_and_sequences(spark):
    rng = random.Random(4)
    texts = [None, "", "word " * 9000, "same text", "same text"] + [" ".join("ab" * rng.randint(1, 3) for _ in range(rng.randint(1, 1500))) for _ in range(120)]
    df = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    pieces = packing.token_pieces(df.repartition(3), PATH)
    out = packing.pack(pieces, block=40).collect()
    encoder = packing.word_encoder(PATH)
    for i, t in enumerate(texts):
        ids = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in out if r.doc_id == (i or None)), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [(k, 4096 * k, len(ids[4096 * k :][:4096]), zlib.crc32(ids[4096 * k :][:4096].tobytes())) for k in range(-(-len(ids) // 4096))]
    total = 0
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += 1
    assert total <= -(-sum(r.length for r in out) // 4096) + 2
    assert packing.pack(packing.token_pieces(df.limit(0), PATH)).count() == 0


def test_many_small_pieces_do_not_nest():
    sizes = [1400] * 101 + [1] * 2500
    bins = packing.complete(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 4096 for b in bins) and len(bins) <= len(packing.best_fit(sizes, 4096))


def test_kept_ids_are_bounded(monkeypatch):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(packing, "KEPT_PIECES", 3)
    texts = ["one two three four five", "x" * 500 + " one", "six seven eight nine ten", "one"]
    for text in texts * 2:
        assert encoder.encode([text]) == [encoder.whole(text)]
        assert all(len(c) <= packing.KEPT_CHARS for c in encoder.chunks)
    encoder.forget()
    assert not encoder.chunks and not encoder.pieces
