from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.functions.text import clean_number, fold, model_token, name_tokens, period_label, safe_message, words
from gridloom.operators.diagnostics import csv_guard, gate, leak_hits
from gridloom.operators.identities import best_signs, residuals, row_scale, tied_rows, value_triples, verdict
from gridloom.operators.stages import Skip, grouped_errors, run_stage


def series(spark, rows):
    return spark.createDataFrame([("k", r, date(2025 + i, 6, 30), v) for r, vs in rows.items() for i, v in enumerate(None if x is None else float(x) for x in vs)], "k string, r int, p date, v double")


def test_triples_and_ties(spark):
    v = series(spark, {1: [10.0, 12, 15], 2: [4.0, 5, 6], 3: [6.0, 7, 9], 4: [-4.0, -5, -6], 5: [1.0, 1, 1], 6: [10.0, 12, None]})
    got = {(r.a, r.b, r.c, r.sign_b, r.sign_c) for r in value_triples(v, ["k"], "r", "p", "v").collect()}
    assert (1, 2, 3, 1, 1) in got and (1, 3, 4, 1, -1) in got and all(5 not in t[:3] and 6 not in t[:3] for t in got)
    assert {(r.r, r.class_row, r.sign) for r in tied_rows(v, ["k"], "r", "p", "v").collect()} == {(2, 2, 1), (4, 2, -1)}


def test_identity_invariance(spark):
    v = series(spark, {1: [10.0, 12, 15], 2: [4.0, 5, 6], 3: [6.0, 7, 9]})
    coef = F.when(F.col("r") == 1, -1.0).otherwise(1.0)
    parts = v.withColumn("coef", coef).withColumn("flex", F.col("r") == 3)
    holds = verdict(residuals(parts, ["k"], "p", "coef", "v", 3), ["k"], "p").first()
    assert (holds.status, holds.n_periods) == ("holds", 3)
    flipped = parts.withColumn("v", F.when(F.col("r") == 3, -F.col("v")).otherwise(F.col("v")))
    assert verdict(residuals(flipped, ["k"], "p", "coef", "v", 3), ["k"], "p").first().status == "fails"
    best = best_signs(flipped, ["k"], "p", "coef", "v", "flex", 3).first()
    assert (best.convention, best.max_residual) == (-1, 0.0)
    scale = {r.r: (r.scale, r.is_static) for r in row_scale(series(spark, {1: [2.0, 2, 2], 2: [1.0, 2, 3]}), ["r"], "v").collect()}
    assert scale == {1: (2.0, True), 2: (3.0, False)}


def test_text_functions(spark):
    df = spark.createDataFrame([("ＡＢＣ Straße", "CashFlowNPV2 west", "Row 12 of 'Wombat' at /srv/deals/x failed on 2024-01-05 with 12345.6 in S3 R[1]C", date(2026, 6, 30))], "a string, n string, m string, d date")
    r = df.select(fold("a").alias("f"), words(F.col("a")).alias("w"), name_tokens(F.col("n")).alias("t"), safe_message(F.col("m"), ["row", "of", "at", "failed", "on", "with", "in"]).alias("m"), period_label(F.col("d"), F.lit("annual")).alias("y"), period_label(F.col("d"), F.lit("monthly")).alias("q"), clean_number(F.lit(float("nan"))).alias("x"), model_token(F.lit("a")).alias("k")).first()
    assert r.f == "abc strasse" and list(r.w)[-1] == "straße" and list(r.t) == ["Cash", "Flow", "NPV", "2", "west"] and (r.y, r.q, r.x, r.k) == ("FY2026", "Jun-26", None, "Mca978112")
    assert r.m == "Row 12 of '…' at <path> failed on <date> with # in S3 R[1]C"


def test_stages_and_leaks(spark):
    df = spark.createDataFrame([("w1", 1), ("w2", 0), ("w3", -1)], "workbook_id string, v int")

    def stage(pdf):
        if pdf.v.iloc[0] < 0:
            raise Skip("nothing here")
        return {"x": 1 / pdf.v.iloc[0].item()}

    status = run_stage(df, "census", stage)
    assert {r.workbook_id: r.status for r in status.collect()} == {"w1": "ok", "w2": "failed", "w3": "skipped"}
    assert [r.n_workbooks for r in grouped_errors(status, ["zerodivisionerror", "in", "stage", "division", "by", "zero"]).collect()] == [1]
    docs = spark.createDataFrame([(1, "the toll income rose"), (2, "tolls"), (3, None), (4, "naïve"), (5, "=1+1")], "i int, t string")
    phrases = spark.createDataFrame([("toll income",), ("income",), ("",)], "phrase string")
    hits = leak_hits(docs.filter("t is not null"), ["i"], words(F.col("t")), phrases)
    assert sorted((r.i, r.phrase) for r in hits.collect()) == [(1, "income"), (1, "toll income")]
    assert {r.i: r.reason for r in gate(docs, ["i"], "t", hits).collect()} == {1: "hit", 2: None, 3: "unreadable", 4: "non-ascii", 5: None}
    assert leak_hits(docs, ["i"], words(F.col("t")), phrases.limit(0)).count() == 0
    assert [r.c for r in docs.filter("i = 5").select(csv_guard(F.col("t")).alias("c")).collect()] == ["'=1+1"]


@pytest.mark.parametrize("n", [1])
def test_llm_is_optional(n):
    import subprocess
    import sys

    code = "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests", 1)[0]).returncode == 0


def test_small_rows_take_part_in_triples(spark):
    from gridloom.plans.workbooks import QUERIES

    large = {i: [1e6 + 7919 * i * i * (i + 1), 1e6 + 104729 * i**3, 2e6 + 31 * i**4] for i in range(1, 91)}
    v = series(spark, large | {91: [10.0, 12, 15], 92: [4.0, 5, 6], 93: [6.0, 7, 9]})
    assert (91, 92, 93, 1, 1) in {(r.a, r.b, r.c, r.sign_b, r.sign_c) for r in value_triples(v, ["k"], "r", "p", "v").collect()}
    assert "value_triples" in QUERIES
