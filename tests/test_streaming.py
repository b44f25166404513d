from gridloom.sources.ooxml import write_workbook
import pytest

from gridloom.streaming.ingest import Busy, Progress, event_windows, latest_status, registry, remove, safe_name, start_ingest
from pyspark.sql import functions as F


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    book = write_workbook({"A": [(1, 1, None, "x"), (1, 2, "=1+1", 2.0)]})
    (src / "one.xlsx").write_bytes(book)
    (src / "copy.xlsx").write_bytes(book)
    (src / "bad.xlsx").write_bytes(b"nothing")

    def run():
        q = start_ingest(spark, str(src), str(out), str(tmp_path / "cp"), once=True)
        q.awaitTermination()

    run()
    assert sorted(r.status for r in registry(spark, str(out)).collect()) == ["done", "error"]
    (src / "again.xlsx").write_bytes(book)
    (src / "two.xlsx").write_bytes(write_workbook({"B": [(2, 2, None, 5.0)]}))
    run()
    got = latest_status(registry(spark, str(out))).collect()
    assert sorted(r.status for r in got) == ["done", "done", "error"]
    assert spark.read.parquet(str(out / "cells")).count() == 3
    gone = registry(spark, str(out)).filter("filename = 'two.xlsx'").first().workbook_id
    with pytest.raises(Busy):
        remove(spark, str(out), gone, {gone})
    with pytest.raises(ValueError):
        remove(spark, str(out), "../x")
    assert remove(spark, str(out), gone) >= 1 and remove(spark, str(out), "Wnone") == 0
    assert spark.read.parquet(str(out / "cells")).count() == 2 and registry(spark, str(out)).filter(F.col("workbook_id") == gone).count() == 0
    (src / "two again.xlsx").write_bytes((src / "two.xlsx").read_bytes())
    run()
    assert spark.read.parquet(str(out / "cells")).count() == 3


def test_progress_is_throttled():
    now, told = [0.0], []
    p = Progress(lambda step, share: told.append((step, share)), lambda: now[0])
    for i in range(10):
        now[0] += 0.1
        p("cells", i / 10)
    p("done", 1.2)
    assert told == [("cells", 0.0), ("cells", 0.3), ("cells", 0.6), ("cells", 0.9), ("done", 1.0)]


def test_safe_name(spark):
    names = ["/a/b/Model v1.xlsx", "C:\\x\\CON.xlsx", "/x/..a?b.xlsx", "/x/"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(safe_name(F.col("n")).alias("s")).collect()]
    assert got == ["Model v1.xlsx", "_CON.xlsx", "a_b.xlsx", "workbook"]


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0), ("2024-01-02 01:10:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    batch = {(str(r.window_start), r.event_type): (r.n, r.total) for r in event_windows(df).collect()}
    assert batch["2024-01-01 00:00:00", "a"] == (2, 3.0) and len(batch) == 3
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = event_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ev").count() == 3
