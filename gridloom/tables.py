"""Reading the stored tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks in the sense of Unicode White_Space, with zero-width space and byte order mark.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: The same as a class in Java regular expressions.
BLANK = f"[{BLANKS}]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table as a DataFrame; nothing is read before an action."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (local tests) a folder of
    this machine is made, which is right because driver and executors are then one machine.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whichever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


#: Whether Spark deletes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of each application's intermediate tables.
_SESSIONS: dict[tuple[str, str], str] = {}


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables in the shared folder; it is deleted when the driver ends."""
    key = spark.sparkContext.applicationId, shared_dir(spark).rstrip("/")
    if key not in _SESSIONS:
        at = f"{key[1]}/gridloom-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SESSIONS[key] = at
    return _SESSIONS[key]


def new_folder(spark: SparkSession) -> str:
    """A path of its own among the intermediate tables, not made yet."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables made so far: for long sessions, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_SESSIONS.pop((spark.sparkContext.applicationId, shared_dir(spark).rstrip("/")), f"{shared_dir(spark).rstrip('/')}/gridloom-none"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and survives lost executors.

    The shuffle files of the write are deleted with it; else they stay on disk until the driver collects its garbage.
    """
    at = new_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.parquet(at)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` stay under ``most``; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def trimmed(col: Column) -> Column:
    """Text without outer blanks of any kind, non-breaking ones included."""
    return F.btrim(col, F.lit(BLANKS))


def sheet_key(col: Column) -> Column:
    """Sheet names agree whatever their case, outer blanks and quotes: the form that is compared.

    A quoted name doubles the quotes inside it; unquoted names are left as they are but for case and blanks.
    """
    t = trimmed(col)
    quoted = t.startswith("'") & t.endswith("'") & (F.length(t) > 1)
    inner = trimmed(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'")))
    return F.lower(F.when(quoted, inner).otherwise(t))


def kept(df: DataFrame, name: str, version: str) -> DataFrame:
    """A result kept in the shared folder under its name and the version of what made it: made once, then read.

    It is written beside its place and moved there when whole, so a reader finds all of it or nothing. Keep results of
    tables that do not change under the same ``name``; a new ``version`` makes a new one.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/gridloom-kept-{name}-{version}"
    if not path_exists(spark, f"{at}/_SUCCESS"):
        part = new_folder(spark)
        df.write.parquet(part)
        here, there = spark._jvm.org.apache.hadoop.fs.Path(part), spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.rename(here, there) and not path_exists(spark, f"{at}/_SUCCESS"):
            raise RuntimeError(f"could not keep {name}")
    return spark.read.schema(df.schema).parquet(at)
