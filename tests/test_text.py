import pytest
from pyspark.sql import functions as F

from tomewright.functions import text


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_in_many_languages(spark):
    names = ["Chapter 5.1.cbz", "Ch. 10.2.cbz", "Ch 15.3.cbz", "Episode 3.5.cbz", "第2.4話.cbz", "Cap. 8.7.cbz", "Capítulo 12.1.cbz", "Chương 4.3.cbz", "Chapter 5.cbz", "第23話.cbz", "บทที่ 7", "제 3 화"]
    assert column(spark, names, text.extract_number) == ["5.1", "10.2", "15.3", "3.5", "2.4", "8.7", "12.1", "4.3", "5", "23", "7", "3"]
    assert column(spark, ["NoNumberFile.cbz", "Chapter.cbz", "Ch..cbz", "", None], text.extract_number) == [None] * 5
    assert column(spark, ["vol 7", "Chapter 2-1"], text.extract_number) == ["7", "2.1"]
    assert column(spark, ["vol 7"], text.keyword_number) == [None]


def test_base_and_corrected_numbers(spark):
    assert column(spark, ["5.1", "10.25", "7", "42.0", "x.5", "-1.5"], text.base_number) == ["5", "10", "7", "42", "x", "-2"]
    df = spark.createDataFrame([("3", "Chapter 4.5"), ("4.50", "Chapter 4.5"), ("", "第7話"), ("x", "none"), (None, "第7話-2"), ("1", None)], "n string, t string")
    got = [r.x for r in df.select(text.corrected_number(F.col("n"), F.col("t")).alias("x")).collect()]
    assert got == ["4.5", "4.50", "7", "x", "7.2", "1"]


def test_resolution_order(spark):
    df = spark.createDataFrame([("9", "Chapter 1", "Ch 2"), ("", "Chapter 1", "Ch 2"), (None, "x", "Ch 2"), (None, "x", "7")], "n string, t string, f string")
    assert [r.x for r in df.select(text.resolve_number(F.col("n"), F.col("t"), F.col("f")).alias("x")).collect()] == ["9", "1", "2", None]


def test_escaping(spark):
    names = [".", "..", "...", ".. ", "", " ", "Normal Title", "Oshi no Ko...", "a/b"]
    assert column(spark, names, text.escape_directory_name) == ["%2E", "%2E%2E", "%2E%2E%2E", "%2E%2E", "%20", "%20", "Normal Title", "Oshi no Ko...", "a%2Fb"]


def test_upscaled_paths(spark):
    paths = ["a/_upscaled/b.cbz", "_upscaled/b.cbz", "a\\_upscaled\\b", "a_upscaled/b", "a/_upscaled"]
    assert column(spark, paths, text.is_upscaled_path) == [True, True, True, False, False]
    assert column(spark, paths[:2], text.canonical_path) == ["a/b.cbz", "/b.cbz"]


@pytest.mark.parametrize("old,new,parts", [("abc", "axc", ("a", "x", "c")), ("aa", "aaa", ("aa", "a", "")), ("", "x", ("", "x", "")), ("same", "same", ("same", "", "")), (None, "é", ("", "é", ""))])
def test_string_diff(spark, old, new, parts):
    df = spark.createDataFrame([(old, new)], "a string, b string")
    assert tuple(df.select(text.string_diff(F.col("a"), F.col("b")).alias("d")).collect()[0].d) == parts


def test_natural_order(spark):
    df = spark.createDataFrame([(v,) for v in ("Chapter 10", "Chapter 2", "Chapter 1.5", None, "chapter 1")], "v string")
    assert [r.v for r in df.orderBy(text.chapter_key(F.col("v"))).collect()] == [None, "chapter 1", "Chapter 1.5", "Chapter 2", "Chapter 10"]
    tokens = [t[0] or t[1] for t in __import__("re").findall(text.NATURAL_MIXED, "12.5 v2.0.1")]
    assert tokens[:3] == ["12", ".", "5"]
    brands = spark.createDataFrame([("Brand#17",), ("Brand#2",), ("Brand#100000000000000000000",)], "v string")
    assert [r.v for r in brands.orderBy(text.natural_key_strict(F.col("v"))).collect()] == ["Brand#2", "Brand#17", "Brand#100000000000000000000"]


def test_formats_and_extensions(spark):
    heads = {"ffd8ff00": ".jpg", "89504e470d0a1a0a": ".png", "524946460000000057454250": ".webp", "424d00": ".bmp", "49492a00": ".tiff", "4d4d002a": ".tiff", "00000020667479706176696600000000": ".avif", "0000": None}
    df = spark.createDataFrame([(bytearray.fromhex(h),) for h in heads], "c binary")
    assert [r.x for r in df.select(text.sniff_format(F.col("c")).alias("x")).collect()] == list(heads.values())
    assert column(spark, [".JPG", "png", ".gif", None], text.mime_type) == ["image/jpeg", "image/png", None, None]
    assert column(spark, ["a.cbz", "b"], lambda c: text.ends_with_any(c, [".cbz", ".zip"])) == [True, False]


def test_merged_names_and_search(spark):
    df = spark.createDataFrame([("Chapter 5.1 - x", "5"), ("none", "5"), (None, "5")], "n string, b string")
    assert [r.x for r in df.select(text.merged_name(F.col("n"), F.col("b")).alias("x")).collect()] == ["Chapter 5 - x", "none", None]
    assert column(spark, ["One PIECE", "x"], lambda c: text.contains_ignore_case(c, " piece ")) == [True, False]
    assert text.valid_regex("") and text.valid_regex("a+") and not text.valid_regex("[")
    assert column(spark, ["<a&'\">"], text.html_encode) == ["&lt;a&amp;&#39;&quot;&gt;"]
