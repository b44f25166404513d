"""Continuous ingest of workbooks: each file content once, restartable, with a status table.

A file's SHA-256 is its identity. A batch that is run again after a crash overwrites exactly what it wrote before,
as its registry rows are a folder named by the batch and its table rows are partitions named by the workbook.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.ooxml import parse_files, split_records

FILE = "path string, modificationTime timestamp, length long, content binary"
REGISTRY = "sha256 string, workbook_id string, filename string, size long, status string, error string, n_sheets long, n_cells long, queued_at timestamp"


def safe_name(path: F.Column) -> F.Column:
    """File name without folders, control characters, marks that file systems refuse, and outer dots or blanks; 120 characters at most."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), r'[<>:"/\\|?*]', "_")
    plain = F.regexp_replace(plain, r"^[. ]+|[. ]+$", "")
    reserved = plain.rlike(r"(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\.|$)")
    return F.substring(F.when(reserved, F.concat(F.lit("_"), plain)).when(plain == "", "workbook").otherwise(plain), 1, 120)


def registry(spark: SparkSession, out: str) -> DataFrame:
    """Known files; empty before the first batch."""
    at = os.path.join(out, "registry")
    fs = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(os.path.join(at, "*"))


def ingest_batch(files: DataFrame, batch: int, out: str) -> None:
    """Adds the files not known yet: parses them, writes their tables, then their registry rows, which commit them."""
    spark = files.sparkSession
    named = files.filter(~F.col("path").rlike(r"/~\$[^/]*$")).withColumn("sha256", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("modificationTime", "path"))
    known = registry(spark, out).filter(F.col("status") == "done").select("sha256")
    new = named.withColumn("_n", first).filter("_n = 1").join(known, "sha256", "left_anti").withColumn("workbook_id", F.concat(F.lit("W"), F.substring("sha256", 1, 12)))
    records = parse_files(new.select("content", "workbook_id")).persist()
    try:
        for name, df in split_records(records).items():
            df.repartition("workbook_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workbook_id").parquet(os.path.join(out, name))
        counts = records.groupBy("workbook_id").agg(
            F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"), F.count_if(F.col("kind") == "sheet").alias("n_sheets"), F.count_if(F.col("kind") == "cell").alias("n_cells"))
        rows = new.select("sha256", "workbook_id", safe_name(F.col("path")).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("queued_at")).join(counts, "workbook_id", "left")
        rows = rows.withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("error"))
        rows.select(*[c.split(" ")[0] for c in REGISTRY.split(", ")]).write.mode("overwrite").parquet(os.path.join(out, "registry", f"batch-{batch}"))
    finally:
        records.unpersist()


def start_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A query that ingests workbooks as they arrive under ``folder``; with ``once`` it ends when all are in."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(folder)
    write = files.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, out)).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime="5 seconds")).start()


def latest_status(reg: DataFrame) -> DataFrame:
    """One row a file: done wins over error, then the newest."""
    return reg.groupBy("sha256").agg(F.max_by(F.struct("workbook_id", "filename", "size", "status", "error", "n_sheets", "n_cells"), F.struct(F.col("status") == "done", "queued_at")).alias("x")).select("sha256", "x.*")


class Busy(RuntimeError):
    """A workbook that is being built cannot be removed or built again."""


def remove(spark: SparkSession, out: str, workbook_id: str, building: set[str] = frozenset()) -> int:
    """Take a workbook out of the tables and the registry; returns how many folders of it there were.

    Refused while it is in ``building``. Only folders named by the workbook inside the output's tables are deleted. Its
    registry rows are rewritten batch by batch, so the same content is taken in again when it arrives next.
    """
    if workbook_id in building:
        raise Busy(workbook_id)
    if not workbook_id or "/" in workbook_id or workbook_id.startswith("."):
        raise ValueError("no name of a workbook")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs, n = fs_path(out).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    if not fs.exists(fs_path(out)):
        return 0
    for table in fs.listStatus(fs_path(out)):
        own = fs_path(f"{table.getPath()}/workbook_id={workbook_id}")
        n += bool(table.isDirectory() and fs.exists(own) and fs.delete(own, True))
    at = fs_path(os.path.join(out, "registry"))
    for batch in fs.listStatus(at) if fs.exists(at) else []:
        path = str(batch.getPath())
        rows = spark.read.schema(REGISTRY).parquet(path)
        if not rows.filter(F.col("workbook_id") == workbook_id).isEmpty():
            left = spark.createDataFrame(rows.filter(F.col("workbook_id") != workbook_id).collect(), REGISTRY)  # one batch's files
            left.write.mode("overwrite").parquet(path)
    return n


class Progress:
    """Reports of a build, passed on at most every quarter of a second; the last one always is."""

    def __init__(self, tell: Callable[[str, float], None], clock: Callable[[], float] = time.monotonic, every: float = 0.25) -> None:
        self.tell, self.clock, self.every, self.at = tell, clock, every, float("-inf")

    def __call__(self, step: str, share: float) -> None:
        now = self.clock()
        if share >= 1 or now - self.at >= self.every:
            self.at = now
            self.tell(step, min(1.0, max(0.0, share)))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type, for batch and stream alike; late events count until the watermark passes."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
