from gridloom.operators.leakscan import forbidden_strings, release, scan

GENERIC = ["revenue", "total", "debt", "sheet", "and", "consolidations", "cons"]


def test_scan(spark):
    sheets = spark.createDataFrame([("w", "Wombat Flows"), ("w", "Cons"), ("v", "Inputs"), ("w", "Debt")], "workbook_id string, sheet string")
    lines = spark.createDataFrame([("w", "Total revenue", "Tolls, net (XQZ)", "$m"), ("w", None, None, None)], "workbook_id string, label string, section string, units string")
    names = spark.createDataFrame([("w", "DealX_9"), ("w", "_xlnm.Print_Area"), ("w", "ab")], "workbook_id string, name string")
    bad = forbidden_strings(sheets, lines, names, GENERIC)
    got = {(r.kind, r.s) for r in bad.filter("workbook_id = 'w'").collect()}
    assert {("sub", "wombatflows"), ("gram", "wombat flows"), ("gram", "total revenue"), ("term", "xqz"), ("term", "wombat"), ("sub", "dealx9"), ("term", "tolls")} <= got and ("sub", "debt") not in got and ("term", "revenue") not in got
    texts = spark.createDataFrame([("w", 1, "consolidations and total revenue"), ("w", 2, "the WombatFlows sheet"), ("w", 3, "S1 holds"), ("v", 4, "wombat"), ("w", 5, None), ("v", 6, "Größe"), ("u", 7, "fine")], "workbook_id string, text_id int, text string")
    hits = scan(texts, bad, GENERIC)
    assert {(r.workbook_id, r.text_id, r.kind, r.s) for r in hits.collect()} == {("w", 1, "gram", "total revenue"), ("w", 2, "sub", "wombatflows")}
    out = {r.workbook_id: r.reason for r in release(texts, hits, spark.createDataFrame([("w",), ("v",)], "workbook_id string")).collect()}
    assert out == {"w": "hit", "v": "non-ascii", "u": "registry unreadable"}
    assert scan(texts.limit(0), bad, GENERIC).count() == 0


def test_long_phrases_are_held_against_the_whole_text(spark):
    from gridloom.functions.text import words
    from gridloom.operators.diagnostics import leak_hits
    from pyspark.sql import functions as F

    say = lambda n, end: " ".join([f"w{i}" for i in range(n)] + [end])
    docs = spark.createDataFrame([(1, say(14, "fin")), (2, say(14, "other")), (3, say(11, "fin"))], "i int, t string")
    hits = leak_hits(docs, ["i"], words(F.col("t")), spark.createDataFrame([(say(14, "fin"),), (say(11, "fin"),)], "phrase string"))
    assert {(r.i, len(r.phrase.split())) for r in hits.collect()} == {(1, 15), (3, 12)}
    bad = spark.createDataFrame([("w", "gram", say(14, "fin"))], "workbook_id string, kind string, s string")
    got = scan(docs.selectExpr("'w' as workbook_id", "i as text_id", "t as text"), bad, [])
    assert [r.text_id for r in got.collect()] == [1]
