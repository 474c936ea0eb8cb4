"""Matching operators on keys that very many rows share."""

from tomewright.operators import match


def _joined(plan):
    """Rows that the joins of an executed plan gave, the largest of them."""
    mine = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    children = plan.children()
    return max([mine, *(_joined(children.apply(i)) for i in range(children.size()))])


def test_originals_of_one_title_are_not_paired_with_each_of_its_files(spark):
    n = 500
    upscaled = spark.range(n).selectExpr("id AS upscaled_id", "IF(id % 2 = 0, 'a/x', 'b') AS file_name", "'a%2Fx' AS escaped", "'same' AS title")
    originals = spark.range(n).selectExpr("999 - id AS chapter_id", "IF(id < 400, 'a/x', 'c') AS file_name", "'same' AS title")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plain plan shows its counts
    try:
        found = match.match_originals(upscaled, originals, "file_name", "escaped", "title").select("upscaled_id", "chapter_id")
        got = {r.upscaled_id: r.chapter_id for r in found.collect()}
        assert got == {i: 600 if i % 2 == 0 else 500 for i in range(n)}
        assert _joined(found._jdf.queryExecution().executedPlan()) <= n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
