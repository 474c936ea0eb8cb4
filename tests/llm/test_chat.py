import hashlib
import random

from pyspark.sql import functions as F

from tomewright.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|x", "<", "|", "\\", "\n", "<\\\\|im_end|>", "assistant", "é🙂", ""]


def _plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in rows]


def test_reading_back_gives_the_turns(spark):
    rng = random.Random(5)
    convs = {}
    for c in range(60):
        n = rng.randint(1, 6)
        convs[c] = [(c, i, rng.choice(["user", "assistant", "sys\\n\ntem", "<|im_sep|>\\"]), "".join(rng.choices(NASTY, k=rng.randint(0, 5)))) for i in range(n)]
    rows = [r for v in convs.values() for r in v]
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c, v in convs.items():
        plain = _plain(v)
        assert [tuple(t) for t in out[c].turns] == plain
        assert out[c].loss_text == "".join(t for r, t in plain if r == "assistant")
        assert sum(x.skip + x.learn for x in out[c].loss_runs) == len(out[c].formatted) - len(chat.END) - 1


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    text = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()[0].formatted
    assert text == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_learnt_text_follows_the_mask(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", "b🙂<|im_sep|>"), (1, 2, "assistant", "<"), (1, 3, "assistant", "|é"), (1, 4, "user", "c")]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert chat.read_back(made).collect()[0].loss_text == "b🙂<|im_sep|><|é"
    other = made.withColumn("loss_runs", F.transform("loss_runs", lambda x: F.struct((x["skip"] + x["learn"]).alias("skip"), F.lit(0).alias("learn"))))
    assert chat.read_back(other).collect()[0].loss_text == ""
    later = made.withColumn("loss_runs", F.transform("loss_runs", lambda x, i: F.struct((x["skip"] + F.when(i == 1, 1).otherwise(0)).alias("skip"), x["learn"].alias("learn"))))
    assert chat.read_back(later).collect()[0].loss_text != "b🙂<|im_sep|><|é"


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", None), (2, 1, "user", "x"), (2, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "f", "t") for r in rows], SCHEMA + ", formatted string, turns string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in out[None].turns] == [("", ""), ("user", "")]
    assert [tuple(t) for t in out[2].turns] == [("user", "x"), ("user", "x")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(7, 1, "assistant", "two"), (7, 0, "user", "one")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    assert out[7].turns_sha256 == hashlib.sha256(b"user\none\nassistant\ntwo\n").hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].loss_chars == len(said) and out[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[-1].n_turns == 2
