"""References to lines that do not exist, per table, cause and month.

A key is a sheet, by a 96-bit digest of (workbook, sheet), and a row. Ranges are runs of 4,096 rows of an equal cut of
the sheets' digests; a range's parents are held as sorted arrays and whole batches of references, single rows and
spans of rows alike, are probed by binary search. A range with more references than one task should take is cut into
shards and its parents are copied to those shards only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.refs import ref_rows
from gridloom.operators.skew import at_task, fragment, plan_shards, replicate
from gridloom.tables import materialise, sheet_key

REASONS = ["missing", "deleted", "late"]
FOREVER = np.iinfo(np.int64).max
PARENTS_PER_RANGE = 100_000
#: Rows of a sheet that lie in one range, as a power of two; spans are looked up in so many expanded rows at a time.
ROW_BITS, ROWS_AT_ONCE = 12, 1_000_000
REF = ["h1", "h2", "r1", "r2", "at", "tab", "fld", "ref_id"]


def _sheet_digest(wb: Column, sheet: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), wb, sheet).alias("h1"), F.hash(F.lit(2), wb, sheet).alias("h2")]


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def parents_of(lines: DataFrame) -> DataFrame:
    """Copies of lines as (h1, h2, r1, loaded, deleted); a copy never loaded proves nothing and is left out."""
    rows = lines.filter("loaded_at is not null and `row` is not null")
    return rows.select(
        *_sheet_digest(F.col("workbook_id"), sheet_key(F.col("sheet"))), F.col("row").cast("int").alias("r1"),
        _micros("loaded_at").alias("loaded"), F.coalesce(_micros("deleted_at"), F.lit(FOREVER)).alias("deleted"),
    )


def edge_refs(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references (h1, h2, r1, r2, at, tab, fld, ref_id)."""
    ends = F.explode(F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("fld"), F.col(f"{e}_sheet").alias("sheet"), F.col(f"{e}_row").cast("int").alias("row")) for k, e in enumerate(("src", "dst"))
    ]))
    out = edges.filter("built_at is not null").select(F.col("edge_id").alias("ref_id"), "workbook_id", _micros("built_at").alias("at"), ends.alias("e")).filter("e.row is not null")
    return out.select(*_sheet_digest(F.col("workbook_id"), sheet_key(F.col("e.sheet"))), F.col("e.row").alias("r1"), F.col("e.row").alias("r2"), "at", F.lit(0).cast("tinyint").alias("tab"), F.col("e.fld").alias("fld"), "ref_id")


def name_refs(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of defined names: the spans of rows their refs take, as references, and the names whose ref is broken."""
    once = names.filter("loaded_at is not null and ref is not null").select("name_id", "workbook_id", "ref", "scope", _micros("loaded_at").alias("at"))

    def spans(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, wb, ref, scope, at in zip(pdf.name_id, pdf.workbook_id, pdf.ref, pdf.scope, pdf["at"]):
                broken, areas = ref_rows(ref, scope)
                if broken:
                    out.append((i, wb, None, 0, 0, at))
                else:
                    out += [(i, wb, s, a, b, at) for s, a, b in areas]
            yield pd.DataFrame(out, columns=["ref_id", "workbook_id", "sheet", "r1", "r2", "at"])

    parsed = materialise(once.mapInPandas(spans, "ref_id long, workbook_id string, sheet string, r1 int, r2 int, at long"))
    tab, fld = F.lit(1).cast("tinyint"), F.lit(2).cast("tinyint")
    refs = parsed.filter("sheet is not null").select(*_sheet_digest(F.col("workbook_id"), sheet_key(F.col("sheet"))), "r1", "r2", "at", tab.alias("tab"), fld.alias("fld"), "ref_id")
    broken = parsed.filter("sheet is null").select(tab.alias("tab"), fld.alias("fld"), "ref_id", "at", F.lit(0).cast("tinyint").alias("why"))
    return refs, broken


def probe(parents: pd.DataFrame, refs: pd.DataFrame) -> np.ndarray:
    """For each reference 0 missing, 1 deleted, 2 late or -1 found, by binary search in sorted arrays.

    Parents are ordered by key and load time; behind each stands the latest deletion among the copies of its key
    loaded so far. A line is there at a time iff the last copy loaded by then has such a deletion after it. A span is
    missing if fewer keys than rows lie in it; else its rows are looked at one by one and the first reason counts.
    """
    n = len(refs)
    why = np.zeros(n, np.int8)
    if not len(parents) or not n:
        return why
    h1, h2, row, loaded, deleted = (parents[c].to_numpy(np.int64) for c in ("h1", "h2", "r1", "loaded", "deleted"))
    order = np.lexsort((loaded, row, h2, h1))
    h1, h2, row, loaded, deleted = h1[order], h2[order], row[order], loaded[order], deleted[order]
    # sheets are numbered in their order, so that sheet and row make one sorted array of keys
    sheet_new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    sheet = np.cumsum(sheet_new) - 1
    place = (sheet << 32) + row
    new = np.r_[True, place[1:] != place[:-1]]
    keys, code = place[new], np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # latest deletion so far within a key: rank deletions, lift each key above the one before, take the running maximum
    times, rank = np.unique(deleted, return_inverse=True)
    latest = times[np.maximum.accumulate(code * len(times) + rank) - code * len(times)]
    q1, q2, r1, r2, at = (refs[c].to_numpy(np.int64) for c in ("h1", "h2", "r1", "r2", "at"))
    k1, k2 = h1[sheet_new], h2[sheet_new]
    lo, hi = np.searchsorted(k1, q1, "left"), np.searchsorted(k1, q1, "right")
    own = np.full(n, -1, np.int64)
    one = hi - lo == 1
    own[one] = np.where(k2[lo[one]] == q2[one], lo[one], -1)
    for i in np.flatnonzero(hi - lo > 1):  # digests equal in h1 alone are told apart by h2
        j = lo[i] + np.searchsorted(k2[lo[i] : hi[i]], q2[i])
        own[i] = j if j < hi[i] and k2[j] == q2[i] else -1
    a = np.searchsorted(keys, (own << 32) + r1, "left")
    b = np.searchsorted(keys, (own << 32) + r2, "right")
    whole = np.flatnonzero((own >= 0) & (b - a == r2 - r1 + 1))
    loads = np.unique(loaded)
    here = code * (len(loads) + 1) + np.searchsorted(loads, loaded, "right")

    def state(key: np.ndarray, t: np.ndarray) -> np.ndarray:
        last = np.searchsorted(here, key * (len(loads) + 1) + np.searchsorted(loads, t, "right"), "right") - 1
        out = np.full(len(key), 2, np.int8)
        seen = last >= first[key]
        out[seen] = np.where(latest[last[seen]] > t[seen], -1, 1)
        return out

    single = whole[r1[whole] == r2[whole]]
    why[single] = state(a[single], at[single])
    spans = whole[r1[whole] < r2[whole]]
    size = (b - a)[spans]
    for part in np.split(np.arange(len(spans)), np.flatnonzero(np.diff(np.cumsum(size) // ROWS_AT_ONCE)) + 1):
        if len(part):
            who, m = spans[part], size[part]
            begin = np.cumsum(m) - m
            each = state(np.arange(m.sum()) - np.repeat(begin - a[who], m), np.repeat(at[who], m))
            why[who] = np.minimum.reduceat(np.where(each < 0, 3, each), begin)
    why[why == 3] = -1
    return why


def orphan_references(lines: DataFrame, edges: DataFrame, names: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every reference of ``edges`` and ``names`` to a line that was not there: table_name, ref_id, field, reason, period.

    A line is there at a time if one of its copies was loaded by then and not deleted by then. A name is a case if
    any row it spans is; the reason is the first that applies of missing, deleted, late. Null or blank refs,
    constants, links to other files, whole columns and refs without a sheet (and without scope) are no cases;
    neither are references without a row or time. Repeated rows count once, clashing extra columns are ignored.
    """
    spans, broken = name_refs(names)
    n = tasks or max(2, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = min(max(n, -(-lines.count() // PARENTS_PER_RANGE)), 2**24)
    # equal cuts of the signed 64-bit space of sheets by its leading 24 bits, and runs of rows
    cut = F.shiftright((F.shiftright("h1", 40) + F.lit(2**23)) * F.lit(cuts), 24).cast("int")
    run = lambda c: F.shiftright(F.col(c), ROW_BITS)
    parents = parents_of(lines).withColumn("cut", cut).withColumn("run", run("r1"))
    low, high = F.shiftleft("run", ROW_BITS), F.shiftleft(F.col("run") + 1, ROW_BITS) - 1
    spans = spans.withColumn("run", F.explode(F.sequence(run("r1"), run("r2")))).withColumn("r1", F.greatest("r1", low)).withColumn("r2", F.least("r2", high))
    refs = materialise(edge_refs(edges).withColumn("run", run("r1")).unionByName(spans).withColumn("cut", cut))
    plan = plan_shards(refs, ["cut", "run"], n)
    a, b = at_task(replicate(parents, plan), plan), at_task(fragment(refs, plan, ["ref_id", "fld", "tab", "h1"]), plan)
    group = ["task", "cut", "run", "shard"]

    def misses(_key: tuple, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        why = probe(p, r)
        return r.loc[why >= 0, ["tab", "fld", "ref_id", "at"]].assign(why=why[why >= 0])

    cols = "tab tinyint, fld tinyint, ref_id long, at long, why tinyint"
    out = a.select(*group, "h1", "h2", "r1", "loaded", "deleted").groupBy(*group).cogroup(b.select(*group, *REF).groupBy(*group)).applyInPandas(misses, cols)
    worst = out.unionByName(broken).groupBy("tab", "fld", "ref_id", "at").agg(F.min("why").alias("why"))
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(c).cast("int") + 1)
    return worst.select(
        pick(["edges", "defined_names"], "tab").alias("table_name"), "ref_id", pick(["src_row", "dst_row", "ref"], "fld").alias("field"),
        pick(REASONS, "why").alias("reason"), F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"),
    ).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, cause and month."""
    return found.groupBy("table_name", "field", "reason", "period").agg(F.count(F.lit(1)).alias("n_refs"))
