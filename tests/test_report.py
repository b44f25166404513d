"""Texts for people: nothing a model is called can break out of a page, nothing is left out silently."""

from gridloom.operators import report
from gridloom.tables import kept


def test_card(spark):
    df = spark.createDataFrame([("Revenue", 1234567.0, 0.12345), ("Tax", None, 3.0)], "line string, value double, share double")
    assert report.card(df, "Lines").splitlines() == ["Lines", "=====", "line     value      share", "Revenue  1,234,567  0.1235", "Tax      –          3"]
    assert report.card(spark.range(report.SHOWN + 5).toDF("i"), "n").endswith("... and 5 more")


def test_page_is_escaped(spark):
    bad = "</script><b>{title}"
    page = report.graph_page(spark.createDataFrame([(bad, 0), ("B", 1)], "node string, layer int"), spark.createDataFrame([(bad, "B"), ("B", "gone")], "src string, dst string"), "<x>")
    assert "</script><b>" not in page and "<\\/script>" in page and "&lt;/script&gt;&lt;b&gt;{title}" in page and "<h1>&lt;x&gt;</h1>" in page and '"gone"' not in page
    assert "<svg" in report.graph_page(spark.createDataFrame([], "node string, layer int"), spark.createDataFrame([], "src string, dst string"), "empty")


def test_statement_text():
    assert report.statement_text([2026, 2027], [("Revenue", [100.0, None]), ("Tax", [-1.5, 2])]).splitlines() == ["         2026  2027", "Revenue   100     –", "Tax      -1.5     2"]


def test_kept(spark):
    import uuid

    name = uuid.uuid4().hex
    assert kept(spark.range(3).toDF("i"), name, "1").count() == 3
    assert kept(spark.range(9).toDF("i"), name, "1").count() == 3 and kept(spark.range(9).toDF("i"), name, "2").count() == 9
