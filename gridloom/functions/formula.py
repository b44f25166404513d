"""Spreadsheet formulas: tokens, references, relative (R1C1) patterns and a tree of calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

MAX_ROW = 1_048_576
LAST_COL = 16_384

_TOKEN = re.compile(
    r"""(?P<text>"(?:[^"]|"")*")
    |(?P<error>\#(?:REF!|N/A|DIV/0!|VALUE!|NAME\?|NUM!|NULL!|SPILL!|CALC!))
    |(?P<array>\{[^{}]*\})
    |(?P<call>[A-Za-z_][A-Za-z0-9_.]*\()
    |(?P<ref>(?:'(?:[^']|'')*'!|(?:\[[^\]]*\])?[^\W\d][\w.]*!)?(?:\$?[A-Za-z]{1,3}\$?\d+(?![\w.(])(?::\$?[A-Za-z]{1,3}\$?\d+)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(])|\$?\d+:\$?\d+))
    |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<name>(?:'(?:[^']|'')*'!|[^\W\d][\w.]*!)?[^\W\d\\][\w.\\?]*(?:\[[^\]]*\])?)
    |(?P<space>\s+)
    |(?P<op><=|>=|<>|[-+*/^&=<>%:@\#])
    |(?P<open>\()|(?P<close>\))|(?P<sep>[,;])""",
    re.X,
)
_END = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)(\d+)$")
_COL = re.compile(r"(\$?)([A-Za-z]{1,3})$")
_ROW = re.compile(r"(\$?)(\d+)$")


class FormulaError(ValueError):
    """The text is no formula this grammar knows."""


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def tokens(formula: str) -> list[tuple[str, str]]:
    """(kind, text) of every token, blanks included; the leading = is left out."""
    out, at = [], 1 if formula.startswith("=") else 0
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if not m:
            raise FormulaError(f"at {at}: {formula[at : at + 20]!r}")
        out.append((m.lastgroup or "", m[0]))
        at = m.end()
    return out


def split_sheet(ref: str) -> tuple[str | None, str]:
    """Sheet (unquoted) and address of a reference text."""
    if "!" not in ref:
        return None, ref
    sheet, addr = ref.rsplit("!", 1)
    return (sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet), addr


@dataclass(frozen=True)
class Area:
    """A rectangle of cells. ``r2`` and ``c2`` may be the last row or, in whole rows, stand for the used width."""

    sheet: str | None
    r1: int
    c1: int
    r2: int
    c2: int
    whole_row: bool = False

    @property
    def single(self) -> bool:
        return (self.r1, self.c1) == (self.r2, self.c2)

    @property
    def size(self) -> int:
        return (self.r2 - self.r1 + 1) * (self.c2 - self.c1 + 1)


def area(ref: str) -> Area | None:
    """The area of an A1 reference text; None for links to other files and what is no address."""
    if "[" in ref:
        return None
    sheet, addr = split_sheet(ref)
    a, _, b = addr.replace(" ", "").partition(":")
    b = b or a
    if (m := _END.match(a)) and (n := _END.match(b)):
        rows, cols = sorted((int(m[4]), int(n[4]))), sorted((column_number(m[2]), column_number(n[2])))
        return Area(sheet, rows[0], cols[0], rows[1], cols[1])
    if (m := _COL.match(a)) and (n := _COL.match(b)) and ":" in addr:
        cols = sorted((column_number(m[2]), column_number(n[2])))
        return Area(sheet, 1, cols[0], MAX_ROW, cols[1])
    if (m := _ROW.match(a)) and (n := _ROW.match(b)) and ":" in addr:
        rows = sorted((int(m[2]), int(n[2])))
        return Area(sheet, rows[0], 1, rows[1], LAST_COL, True)
    return None


def _map_refs(formula: str, f: Callable[[str], str]) -> str:
    try:
        return "=" + "".join(f(t) if k == "ref" else t for k, t in tokens(formula))
    except FormulaError:
        return formula


def _ends(ref: str, f: Callable[[str], str]) -> str:
    head, bang, addr = ref.rpartition("!")
    return head + bang + ":".join(f(x) for x in addr.split(":"))


@lru_cache(1 << 15)
def _pieces(formula: str) -> tuple[str | tuple[str, int, str, int], ...] | None:
    """Texts, and ends of references: mark and number of row and column, -1 where an end has none. None if it cannot be parsed."""
    out: list[str | tuple[str, int, str, int]] = ["="]
    try:
        found = tokens(formula)
    except FormulaError:
        return None
    for kind, text in found:
        if kind != "ref":
            out.append(text)
            continue
        head, bang, addr = text.rpartition("!")
        out.append(head + bang)
        for i, x in enumerate(addr.split(":")):
            if i:
                out.append(":")
            if m := _END.match(x):
                out.append((m[3], int(m[4]), m[1], column_number(m[2])))
            elif m := _COL.match(x):
                out.append(("", -1, m[1], column_number(m[2])))
            elif m := _ROW.match(x):
                out.append((m[1], int(m[2]), "", -1))
            else:
                out.append(x)
    return tuple(out)


def relative(formula: str, row: int, col: int) -> str:
    """The formula with its references relative to its cell: equal along a row that is filled to the right."""
    def part(mark: str, letter: str, there: int, here: int) -> str:
        return f"{letter}{there}" if mark else letter if there == here else f"{letter}[{there - here}]"

    pieces = _pieces(formula)
    if pieces is None:
        return formula
    return "".join(x if isinstance(x, str) else (part(x[0], "R", x[1], row) if x[1] >= 0 else "") + (part(x[2], "C", x[3], col) if x[3] >= 0 else "") for x in pieces)


def moved(formula: str, down: int, right: int) -> str:
    """The formula as it reads when its cell is filled ``down`` rows and ``right`` columns, for shared formulas."""
    def end(x: str) -> str:
        if m := _END.match(x):
            c = m[2] if m[1] else column_letters(max(1, column_number(m[2]) + right))
            r = m[4] if m[3] else str(max(1, int(m[4]) + down))
            return f"{m[1]}{c}{m[3]}{r}"
        if m := _COL.match(x):
            return x if m[1] else column_letters(max(1, column_number(m[2]) + right))
        if m := _ROW.match(x):
            return x if m[1] else str(max(1, int(m[2]) + down))
        return x

    return _map_refs(formula, lambda r: _ends(r, end))


SHAPE = re.compile(r"\$?[A-Z]{1,3}(?=\$?\d)")


def shape(formula: str) -> str:
    """The formula with column letters blotted out: equal along a row."""
    return SHAPE.sub("#", formula)


@dataclass
class Call:
    """A function call; each argument is a flat list of tokens and calls."""

    name: str
    args: list[list] = field(default_factory=lambda: [[]])


def tree(formula: str) -> list:
    """Items of a formula: (kind, text) tokens and calls, brackets kept as tokens, blanks dropped."""
    root: list = []
    levels: list[tuple[list, Call | None]] = []
    now: list = root
    call: Call | None = None
    for kind, text in tokens(formula):
        if kind == "call":
            levels.append((now, call))
            call = Call(text[:-1].upper().removeprefix("_XLFN."))
            now.append(call)
            now = call.args[0]
        elif kind == "open":
            now.append((kind, text))
            levels.append((now, call))
            call = None
        elif kind == "close":
            if not levels:
                raise FormulaError("a bracket too many")
            closed = call
            now, call = levels.pop()
            if closed is None:
                now.append((kind, text))
        elif kind == "sep" and call is not None:
            call.args.append([])
            now = call.args[-1]
        elif kind != "space":
            now.append((kind, text))
    if levels:
        raise FormulaError("a bracket is open")
    return root


def calls(items: list) -> Iterator[Call]:
    """Every call in the items, outer ones first."""
    for x in items:
        if isinstance(x, Call):
            yield x
            for a in x.args:
                yield from calls(a)
