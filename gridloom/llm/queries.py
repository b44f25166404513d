"""Queries of the text problems, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.language import fit_on, language_segments, wrong_labels
from gridloom.llm.packing import pack_documents, pack_summary
from gridloom.llm.tokens import encode, piece_offsets, round_trip, token_counts
from gridloom.llm.vocab import map_labels, map_lines
from gridloom.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return map_lines(read(spark, d, "line_items"), read(spark, d, "role_vocab"), read(spark, d, "unit_refs"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Labels that name no entry, with the rows that bear them."""
    lines = read(spark, d, "line_items")
    none = map_labels(lines, read(spark, d, "role_vocab"), read(spark, d, "unit_refs")).filter("role_id = 0").select("label")
    return lines.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).join(none, "label")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(read(spark, d, "documents"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return piece_offsets(read(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(read(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(token_counts(read(spark, d, "documents")), read(spark, d, "packs"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return pack_summary(p8_packed(spark, d), read(spark, d, "packs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(read(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Main language of each text and the stretches of mixed ones, with confidence."""
    docs = read(spark, d, "documents")
    return language_segments(docs, fit_on(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unmatched, p7_ids, p7_offsets, p7_round_trip, p8_packed, p8_summary, p9_found, p9_segments)
}

# None of these can be said in SQL: tests/llm holds brute-force versions, round trips and held-out accuracy.
ORACLES: dict[str, str] = {}
