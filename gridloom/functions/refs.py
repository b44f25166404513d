"""Reading what a defined name refers to, in A1 and R1C1 notation."""

from __future__ import annotations

import re

_SHEET = r"(?:'((?:[^']|'')*)'|([^\s'!,=()+*/&<>:;]+))!"
_A1 = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d{1,7})(?::\$?([A-Za-z]{1,3})\$?(\d{1,7}))?$")
_R1C1 = re.compile(r"[Rr](\d{1,7})[Cc](\d{1,5})(?::[Rr](\d{1,7})[Cc](\d{1,5}))?$")
_ROWS = re.compile(r"(?:\$?(\d{1,7}):\$?(\d{1,7})|[Rr](\d{1,7})(?::[Rr](\d{1,7}))?)$")
_HEAD = re.compile(_SHEET)


def split_areas(ref: str) -> list[str]:
    """The areas of a ref, parted by commas that stand outside quotes and brackets."""
    out, depth, quoted, at = [], 0, "", 0
    for i, ch in enumerate(ref):
        if quoted:
            quoted = "" if ch == quoted else quoted
        elif ch in "'\"":
            quoted = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch in ",;" and not depth:
            out.append(ref[at:i])
            at = i + 1
    return [x.strip() for x in [*out, ref[at:]]]


def ref_rows(ref: str | None, scope: str | None = None) -> tuple[bool, list[tuple[str, int, int]]]:
    """Whether a ref is broken, and the (sheet, first row, last row) of each of its areas.

    Constants, formulas, whole columns and areas in other files give no area. An area without a sheet lies on the
    sheet the name is scoped to, and gives none where there is no such scope.
    """
    text = (ref or "").strip()
    text = text[1:].strip() if text.startswith("=") else text
    if not text:
        return False, []
    bare = re.sub(r'"(?:[^"]|"")*"', "", text)
    if "#REF!" in bare.upper():
        return True, []
    areas: list[tuple[str, int, int]] = []
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    for area in split_areas(text):
        head = _HEAD.match(area)
        if head:
            sheet = head[1].replace("''", "'") if head[1] is not None else head[2]
            rest = area[head.end() :]
            if sheet.startswith("[") or "[" in sheet and "]" in sheet:
                continue
            again = re.match(rf"(.+):{_SHEET}(.+)$", rest)  # Sheet!A1:Sheet!B2
            if again:
                rest = f"{again[1]}:{again[4]}"
        else:
            sheet, rest = (scope or "").strip(), area
        if not sheet:
            continue
        rest = rest.strip()
        if m := _R1C1.match(rest) or None:
            rows = [int(m[1]), int(m[3] or m[1])]
        elif m := _A1.match(rest):
            rows = [int(m[2]), int(m[4] or m[2])]
        elif m := _ROWS.match(rest):
            rows = [int(m[1] or m[3]), int(m[2] or m[4] or m[3] or m[1])]
        else:
            continue
        areas.append((sheet, min(rows), max(rows)))
    return False, areas
