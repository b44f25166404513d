"""Workbooks in Office Open XML: a reader that needs nothing but the standard library, a DataFrame source, a writer."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.formula import area, column_letters, column_number, moved

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates (fixed values).
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MAX_ARRAY = 100_000
RECORD = "kind string, workbook_id string, sheet_pos int, sheet string, state string, `row` int, col int, addr string, formula string, value string, value_kind string, value_num double, value_text string, value_date date, name string, ref string, scope string"
_ADDR = re.compile(r"([A-Z]{1,3})(\d+)$")


def _dated(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and "general" not in bare.lower()


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in root.iter(f"{MAIN}numFmt")}
    cells = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or n in own and _dated(own[n])}


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.findall(f"{MAIN}si")]


def serial_date(x: float, base_1904: bool = False) -> date:
    """Date of a spreadsheet serial; the 1900 system counts a 29 February 1900 that never was."""
    if base_1904:
        return date(1904, 1, 1) + timedelta(days=int(x))
    return date(1899, 12, 30 if x >= 60 else 31) + timedelta(days=int(x))


def read_workbook(content: bytes, workbook_id: str) -> Iterator[dict]:
    """Records of one workbook: its sheets, non-empty cells and defined names.

    Booleans are saved as 1 and 0, dates as ISO text with a date beside it, errors as their text. Shared formulas
    are written out for each cell, array formulas over a range as ``INDEX(formula, i, j)`` unless the range is huge.
    """
    z = zipfile.ZipFile(io.BytesIO(content))
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {x.get("Id"): x.get("Target", "") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    strings, dated = _strings(z), _date_styles(z)
    props = book.find(f"{MAIN}workbookPr")
    base_1904 = props is not None and props.get("date1904") in ("1", "true")
    sheets = book.findall(f"{MAIN}sheets/{MAIN}sheet")
    for pos, sh in enumerate(sheets):
        name = sh.get("name", "")
        yield {"kind": "sheet", "workbook_id": workbook_id, "sheet_pos": pos, "sheet": name, "state": sh.get("state", "visible")}
        target = rels.get(sh.get(f"{REL}id"), "")
        target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if target in z.namelist():
            with z.open(target) as f:
                for c in _cells(f, strings, dated, base_1904):
                    yield {"kind": "cell", "workbook_id": workbook_id, "sheet_pos": pos, "sheet": name, **c}
    for dn in book.findall(f"{MAIN}definedNames/{MAIN}definedName"):
        local = dn.get("localSheetId", "")
        scope = sheets[int(local)].get("name") if local.isdigit() and int(local) < len(sheets) else None
        yield {"kind": "name", "workbook_id": workbook_id, "name": dn.get("name"), "ref": (dn.text or "").strip(), "scope": scope}


def _cells(f: io.BufferedIOBase, strings: list[str], dated: set[int], base_1904: bool) -> Iterator[dict]:
    shared: dict[str, tuple[str, int, int]] = {}
    array: dict[tuple[int, int], str] = {}
    at_row = 0
    for event, el in ET.iterparse(f, events=("start", "end")):
        if event == "start":
            if el.tag == f"{MAIN}row":
                at_row, at_col = int(el.get("r", at_row + 1)), 0
            continue
        if el.tag == f"{MAIN}row":
            el.clear()
            continue
        if el.tag != f"{MAIN}c":
            continue
        m = _ADDR.match(el.get("r") or "")
        row, col = (int(m[2]), column_number(m[1])) if m else (at_row, at_col + 1)
        at_col = col
        fe, ve, kind = el.find(f"{MAIN}f"), el.find(f"{MAIN}v"), el.get("t", "n")
        formula = array.pop((row, col), None)
        if fe is not None:
            text, how, ref = fe.text or "", fe.get("t"), (fe.get("ref") or "").replace("$", "")
            if how == "shared":
                if text:
                    shared[fe.get("si", "")] = (text, row, col)
                base = shared.get(fe.get("si", ""))
                formula = moved(f"={base[0]}", row - base[1], col - base[2]) if base else None
            elif text:
                formula = f"={text}"
                box = area(ref) if how == "array" and ":" in ref else None
                if box and (box.r1, box.c1) == (row, col) and (box.r2 - box.r1 + 1) * (box.c2 - box.c1 + 1) <= MAX_ARRAY:
                    array |= {(r, c): f"=INDEX({text},{r - row + 1},{c - col + 1})" for r in range(box.r1, box.r2 + 1) for c in range(box.c1, box.c2 + 1)}
                    formula = array.pop((row, col))
        raw = ve.text if ve is not None else None
        out = {"row": row, "col": col, "addr": f"{column_letters(col)}{row}", "formula": formula}
        if kind == "inlineStr":
            raw, kind = "".join(t.text or "" for t in el.iter(f"{MAIN}t")), "str"
        if raw is None or raw == "":
            if formula is not None:
                yield out
            continue
        if kind == "s":
            raw, kind = strings[int(raw)], "str"
        if kind == "str":
            if raw != "":
                yield out | {"value": raw, "value_kind": "text", "value_text": raw}
            elif formula is not None:
                yield out
        elif kind == "e":
            yield out | {"value": raw, "value_kind": "error", "value_text": raw}
        elif kind == "b":
            yield out | {"value": "1" if raw in ("1", "true") else "0", "value_kind": "bool", "value_num": 1.0 if raw in ("1", "true") else 0.0}
        elif kind == "d":
            yield out | {"value": raw, "value_kind": "date", "value_date": datetime.fromisoformat(raw[:10]).date()}
        else:
            x = float(raw)
            if int(el.get("s", 0)) in dated and 0 <= x < 2_958_466:
                d = serial_date(x, base_1904)
                yield out | {"value": d.isoformat(), "value_kind": "date", "value_date": d}
            else:
                yield out | {"value": f"{int(x)}" if x == int(x) and abs(x) < 1e15 else repr(x), "value_kind": "num", "value_num": x}
        el.clear()


def load_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all workbooks under ``folder`` (.xlsx, .xlsm, no ``~$`` files), one task a file; repeats of a file once.

    ``workbook_id`` is W and the first hexadecimal digits of the file's SHA-256. A file that cannot be read gives one
    record of kind ``error`` with the reason in ``value``, and the others are read all the same.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xls[xm]").load(folder)
    files = files.filter(~F.col("path").rlike(r"/~\$[^/]*$")).withColumn("workbook_id", F.concat(F.lit("W"), F.substring(F.sha2("content", 256), 1, 12)))
    return parse_files(files.dropDuplicates(["workbook_id"]).select("content", "workbook_id"))


def parse_files(files: DataFrame) -> DataFrame:
    """Records of files given as (content, workbook_id); they leave a task in batches of 50,000."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32()}
    fields = [c.replace("`", "").split(" ") for c in RECORD.split(", ")]
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wb in zip(batch.column("content"), batch.column("workbook_id")):
                rows: list[dict] = []
                try:
                    for rec in read_workbook(content.as_py(), wb.as_py()):
                        rows.append(rec)
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                except Exception as e:  # one broken file never stops the others
                    rows.append({"kind": "error", "workbook_id": wb.as_py(), "value": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORD)


def split_records(records: DataFrame) -> dict[str, DataFrame]:
    """Tables ``sheets``, ``cells`` and ``names`` of loaded records."""
    of = lambda k: records.filter(F.col("kind") == k)
    return {
        "sheets": of("sheet").select("workbook_id", "sheet_pos", "sheet", "state"),
        "cells": of("cell").select("workbook_id", "sheet", "row", "col", "addr", "formula", "value", "value_kind", "value_num", "value_text", "value_date"),
        "names": of("name").select("workbook_id", "name", "ref", "scope"),
    }


def write_workbook(sheets: dict[str, list[tuple[int, int, str | None, object]]], names: dict[str, str] | None = None) -> bytes:
    """A small workbook of (row, column, formula, saved value) cells, as tests need them."""
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        tabs = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        defined = "".join(f"<definedName name={quoteattr(n)}>{escape(r)}</definedName>" for n, r in (names or {}).items())
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets>{tabs}</sheets><definedNames>{defined}</definedNames></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, cells in enumerate(sheets.values(), 1):
            rows: dict[int, list[str]] = {}
            for r, c, formula, v in sorted(cells, key=lambda x: (x[0], x[1])):
                f = f"<f>{escape(formula.lstrip('='))}</f>" if formula else ""
                at = f'r="{column_letters(c)}{r}"'
                if isinstance(v, bool):
                    x = f'<c {at} t="b">{f}<v>{int(v)}</v></c>'
                elif isinstance(v, date):
                    x = f'<c {at} s="1">{f}<v>{(v - date(1899, 12, 30)).days}</v></c>'
                elif isinstance(v, (int, float)):
                    x = f"<c {at}>{f}<v>{v!r}</v></c>"
                elif isinstance(v, str) and v.startswith("#"):
                    x = f'<c {at} t="e">{f}<v>{escape(v)}</v></c>'
                elif v is None:
                    x = f"<c {at}>{f}</c>"
                else:
                    x = f'<c {at} t="str">{f}<v>{escape(str(v))}</v></c>'
                rows.setdefault(r, []).append(x)
            body = "".join(f'<row r="{r}">{"".join(xs)}</row>' for r, xs in rows.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()
