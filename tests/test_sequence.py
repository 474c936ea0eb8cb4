import pytest
from pyspark.sql import functions as F

from tomewright.operators import sequence


def groups(spark, numbers, **options):
    df = spark.createDataFrame([("s", n) for n in numbers], "series string, number string")
    out = {}
    for r in sequence.new_part_groups(df, ["series"], "number", **options).collect():
        out.setdefault(r.base, []).append(r.number)
    return {b: sorted(v) for b, v in out.items()}


# Number lists whose grouping is given; cases of our own follow them.
@pytest.mark.parametrize(
    "numbers,want",
    [
        (["5.1", "5.2", "5.3", "99"], {"5": ["5.1", "5.2", "5.3"]}),
        (["10", "10.1", "10.2", "99"], {"10": ["10", "10.1", "10.2"]}),
        (["10", "10.2", "10.3", "99"], {"10": ["10", "10.2", "10.3"]}),
        (["5.1", "5.3", "99"], {}),
        (["2.2", "2.4", "99"], {}),
        (["7.1", "7.2", "7"], {}),
        (["3.1", "3.2", "5.1", "7.1", "7.2", "7.3", "99"], {"3": ["3.1", "3.2"], "7": ["7.1", "7.2", "7.3"]}),
        (["1.1", "1.2", "1.5", "99"], {"1": ["1.1", "1.2"]}),
        (["5", "5.1", "5.2", "5.5", "99"], {"5": ["5", "5.1", "5.2"]}),
        (["4.1", "4.1", "4.2", "99"], {}),
        (["x", "8.1", "99"], {}),
        (["-1.1", "0.0", "0.1", "6.05", "6.1", "99"], {"0": ["0.0", "0.1"]}),
        (["12", "12.1", "13.1", "13.2", "13.4", "20.2", "20.3", "99"], {"12": ["12", "12.1"], "13": ["13.1", "13.2"]}),
        (["8.10", "8.2", "8.3", "99"], {"8": ["8.10", "8.2", "8.3"]}),
    ],
)
def test_part_groups(spark, numbers, want):
    assert groups(spark, numbers) == want


def test_latest_can_be_included(spark):
    assert groups(spark, ["7.1", "7.2"], include_latest=True) == {"7": ["7.1", "7.2"]}


def test_additions(spark):
    merged = spark.createDataFrame([("s", "2", "2.1"), ("s", "2", "2.2"), ("s", "1", "1.1"), ("s", "1", "1.2")], "series string, base string, number string")
    found = spark.createDataFrame([("s", "2.3", "a"), ("s", "1.5", "b"), ("s", "9.1", "c"), ("s", "2.31", "d")], "series string, number string, file string")
    assert [r.file for r in sequence.part_additions(found, merged, ["series"], "number").collect()] == ["a"]


def test_strict_groups(spark):
    df = spark.createDataFrame([("a", "1.1", "1"), ("a", "1.2", "1"), ("b", "1.1", "1"), ("b", "1.3", "1")], "k string, n2 string, b string")
    got = {r.k: r.consecutive for r in sequence.strictly_consecutive(df, ["k"], "n2", "b").collect()}
    assert got == {"a": True, "b": False}


def test_repair_uses_the_repaired_predecessor(spark):
    df = spark.range(1).select(F.expr("array(named_struct('start',0,'end',9,'pages',10), named_struct('start',5,'end',4,'pages',3), named_struct('start',11,'end',20,'pages',10))").alias("p"))
    got = [(x.start, x.end) for x in df.select(sequence.repaired_ranges(F.col("p")).alias("f")).collect()[0].f]
    assert got == [(0, 9), (10, 12), (13, 22)]
    empty = spark.range(1).select(F.expr("cast(array() as array<struct<start:bigint,end:bigint,pages:bigint>>)").alias("p"))
    assert empty.select(sequence.repaired_ranges(F.col("p")).alias("f")).collect()[0].f == []


def test_labels_and_segments(spark):
    df = spark.createDataFrame([(7,), (12345,)], "i int")
    assert [r.x for r in df.select(sequence.page_label(F.col("i")).alias("x")).collect()] == ["0007", "12345"]
    cuts = spark.createDataFrame([("p", 100, c) for c in (30, 30, 0, 150, 70)], "page string, h int, cut int")
    got = sorted(tuple(r) for r in sequence.crop_segments(cuts, ["page"], "cut", "h").collect())
    assert got == [("p", 0, 30, "_part1"), ("p", 30, 70, "_part2"), ("p", 70, 100, "_part3")]
    equal = sequence.equal_segments(spark.createDataFrame([(10,)], "h int"), "h", F.lit(3)).collect()
    assert [(r.top, r.bottom) for r in equal] == [(0, 3), (3, 6), (6, 10)]


def test_queue_insert_and_retention(spark):
    q = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0), ("a", 3, 10.0)], "s string, pos int, k double")
    got = sequence.ordered_insert(q, "s", "pos", "k", F.lit("a"), F.lit(5.0)).collect()
    assert {r.insert_at for r in got} == {3} and sorted(r.shifted for r in got) == [1, 2, 4]
    rows = spark.createDataFrame([(i, i // 2) for i in range(9)], "id int, t int")
    # with two to keep, the third newest has t = 3, as has the second: both go
    assert sorted(r.id for r in sequence.keep_newest(rows, "t", 2).collect()) == [8]
    assert sorted(r.id for r in sequence.keep_newest(rows, "t", 3).collect()) == [6, 7, 8]
    assert sequence.keep_newest(rows, "t", 100).count() == 9


def test_positions(spark):
    pages = spark.createDataFrame([("c", "001"), ("c", "7")], "c string, name string")
    want = spark.createDataFrame([("c", 0), ("c", 7), ("c", 9)], "c string, idx long")
    got = {r.idx: r.found for r in sequence.positional_lookup(pages, want, ["c"], [F.col("name")], "name", "idx").collect()}
    assert got == {0: "001", 7: "7", 9: None}
