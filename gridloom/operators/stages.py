"""Stages over workbooks of which one's failure stops neither the others nor the run."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import safe_message

STATUS = "workbook_id string, stage string, status string, error string, seconds double, result string"


class Skip(Exception):
    """Raised by a stage that has nothing to do for a workbook."""


def run_stage(df: DataFrame, stage: str, f: Callable[[pd.DataFrame], dict], key: str = "workbook_id") -> DataFrame:
    """``f`` on each workbook's rows of ``df``: ok with its result as JSON, skipped, or failed with the kind of error.

    Meant for the small per-workbook aggregates that stages read, not for cells: a workbook's rows are one task's.
    """

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import json
        import time

        began, status, error, result = time.time(), "ok", None, None
        try:
            result = json.dumps(f(pdf), default=str, sort_keys=True)
        except Skip as e:
            status, error = "skipped", str(e)
        except Exception as e:
            at = traceback.extract_tb(e.__traceback__)[-1]
            status, error = "failed", f"{type(e).__name__} in {at.name}: {e}"
        return pd.DataFrame([(k[0], stage, status, error, time.time() - began, result)], columns=["workbook_id", "stage", "status", "error", "seconds", "result"])

    return df.groupBy(key).applyInPandas(one, STATUS)


def grouped_errors(status: DataFrame, known: list[str]) -> DataFrame:
    """Failures by scrubbed message, with how many workbooks had them."""
    bad = status.filter("status = 'failed'").withColumn("message", safe_message(F.col("error"), known))
    return bad.groupBy("stage", "message").agg(F.countDistinct("workbook_id").alias("n_workbooks"), F.array_sort(F.collect_set("workbook_id")).alias("workbooks"))
