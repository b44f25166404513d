"""Attribute-value cells of an asset register to one typed row per asset.

The cells of a row meet in a register of slots (column -> newest value) built by ``combineByKey``: mergers are
associative, so copies of a cell are resolved on the map side before anything is shuffled. Header rows found
among the registers tell which attribute a column holds, workbook by workbook: a heading is held against the names and
meanings of the attributes in the table that describes them, word by word. Typed encoders emit the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that mean the same, in any register; they know nothing of the attributes, which come with their table.
WORDS = {
    "asset": "asset assets anlage anlagen equipment item items actif actifs bien biens activo activos",
    "code": "code codes id ids no nr number nummer key numero num kennung identifier",
    "kind": "kind class klasse category kategorie type typ art group gruppe classe categorie clase categoria tipo",
    "place": "site sites location place where stands depot standort ort lieu emplacement ubicacion sitio lugar yard lokation",
    "cost": "cost costs kosten price preis purchase acquisition historic original anschaffung anschaffungs kauf cout prix achat coste precio compra paid",
    "insured": "insured insurance cover covered coverage versicherung versicherungs versichert versicherte assure assuree assurance asegurado seguro",
    "value": "value sum amount wert summe betrag valeur montant somme valor importe",
    "start": "start first begin commissioned commissioning service inbetriebnahme installed installation since mise puesta beginn",
    "use": "use used usage useful nutzung nutzungs betrieb verwendung utilisation uso utile util",
    "day": "date day datum tag jour fecha",
    "life": "life lifetime useful util dauer lebensdauer vie duree vida lifespan",
    "month": "month months monat monate monaten mois mes meses",
    "active": "active aktiv actif activo still operational operating live noch",
}
JOINING = set("a an the of in on or and not it what is still der die das des dem im zu von und le la les de du des en et el los del y d".split())
PLACEHOLDERS = {"", "-", "--", "–", "—", "?", "??", "n/a", "na", "n.a.", "tbc", "tbd", "none", "null", "pending", "unknown", "nil"}
YES, NO = {"1", "1.0", "y", "yes", "true", "t", "ja", "j", "oui", "wahr"}, {"0", "0.0", "n", "no", "false", "f", "nein", "non", "falsch"}
MONTHS = {m: i % 12 + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec jan feb mär apr mai jun jul aug sep okt nov dez".split())}
#: Reducers of the register shuffle take about so many cells each, whatever the size of the table.
CELLS_PER_PARTITION = 50_000
CURRENCY = re.compile(r"(?i)(?:a\$|us\$|[$€£¥₹]|\b(?:aud|usd|eur|euro|gbp|inr|rs)\b\.?)")


def clean(v: str | None) -> str:
    """Without outer blanks of any kind; '' for what is absent, a placeholder or a spreadsheet error."""
    t = (v or "").strip().strip("\u200b\ufeff").strip()
    return "" if t.casefold() in PLACEHOLDERS or t.startswith("#") else t


class Headings:
    """Which attribute a heading names, by the words of the attributes' names and meanings.

    Every word of a heading must belong to what an attribute is about; of several attributes the one wins of whose name
    or meaning most is said, of equals none. Compounds are read as their parts. A heading holds letters and no digits.
    """

    def __init__(self, attrs: list[tuple[str, str]]) -> None:
        self.of = {w: {c for c, ws in WORDS.items() if w in ws.split()} for ws in WORDS.values() for w in ws.split()}
        self.longest = max(map(len, self.of))
        self.said = [(name, said) for name, meaning in attrs for text in (name, meaning) if (said := self.read(text or ""))]
        self.known: dict[str, str | None] = {}

    def word(self, w: str, depth: int = 0) -> list[set[str]] | None:
        """The meanings of a word, or of the words a compound of up to six is made of."""
        if w in self.of:
            return [self.of[w]]
        for cut in range(min(len(w) - 3, self.longest) if depth < 5 else 0, 2, -1):
            if w[:cut] in self.of and (rest := self.word(w[cut:].removeprefix("s") if w[cut:] not in self.of else w[cut:], depth + 1)) is not None:
                return [self.of[w[:cut]], *rest]
        return None

    def read(self, text: str) -> list[set[str]] | None:
        """The meanings of each word; words nobody knows mean themselves."""
        t = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))
        words = [w for w in re.split(r"[\W_]+", t) if w]
        return [m for w in words if w not in JOINING or w in self.of and len(words) == 1 for m in self.word(w) or [{f"={w}"}]]

    def find(self, v: str | None) -> str | None:
        t = (v or "").strip()
        if not t or any(c.isdigit() for c in t):
            return None
        if t not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[t] = self._find(t)
        return self.known[t]

    def _find(self, t: str) -> str | None:
        got = self.read(t)
        if not got or t.casefold() in NO:  # an answer, not the short form of number
            return None
        every, best = set().union(*got), {}
        about: dict[str, set[str]] = {}
        for name, said in self.said:
            about.setdefault(name, set()).update(*said)
        for name, said in self.said:
            if all(m & (about[name] | {"asset"}) for m in got):  # everything in a register is about an asset
                best[name] = max(best.get(name, 0.0), sum(bool(m & every) for m in said) / len(said))
        top = sorted(best.items(), key=lambda x: -x[1])
        return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else None


def number(v: str | None) -> Decimal | None:
    """A figure in the notations of accounts: currency marks, blanks or either mark between thousands, brackets for minus."""
    t = CURRENCY.sub("", clean(v)).replace("−", "-").replace("–", "-").strip()
    if t.startswith("(") and t.endswith(")"):
        t = "-" + t[1:-1]
    if t.endswith("-"):
        t = "-" + t[:-1]
    t = re.sub(r"[\s'’]", "", t)
    dot, comma = t.rfind("."), t.rfind(",")
    if dot >= 0 and comma >= 0:
        t = t.replace(",", "") if dot > comma else t.replace(".", "").replace(",", ".")
    elif comma >= 0:
        t = t.replace(",", "") if re.fullmatch(r"-?\d{1,3}(?:,\d{3})+", t) else t.replace(",", ".", 1)
    elif t.count(".") > 1:
        t = t.replace(".", "")
    try:
        return Decimal(t) if re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", t) else None
    except InvalidOperation:
        return None


def cents(v: str | None) -> int:
    x = number(v)
    return -1 if x is None else int((x * 100).to_integral_value(rounding="ROUND_HALF_UP"))


def months(v: str | None) -> int:
    t = clean(v)
    m = re.fullmatch(r"(?i)(.*?)\s*(m|mths?|mos?|months?|monate?|mois|y|yrs?|years?|jahre?)?\.?", t)
    x = number(m[1]) if m else None
    if x is None:
        return -1
    return int((x * (12 if m[2] and m[2][0].lower() in "yj" else 1)).to_integral_value(rounding="ROUND_HALF_UP"))


def day(v: str | None) -> str:
    """ISO text of a date: year first, day first with dots, named months, or a serial of the 1900 system."""
    t = clean(v)
    try:
        if m := re.match(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:\D|$)", t):
            return date(int(m[1]), int(m[2]), int(m[3])).isoformat()
        if m := re.match(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:\D|$)", t):
            return date(int(m[3]), int(m[2]), int(m[1])).isoformat()
        if m := re.match(r"(\d{1,2})\.?[-\s/]*([^\W\d]{3,})\.?[-\s/,]*(\d{4})$", t):
            return date(int(m[3]), MONTHS[m[2][:3].lower()], int(m[1])).isoformat()
        if re.fullmatch(r"\d{1,6}(?:\.\d+)?", t) and 1 <= float(t):
            n = int(float(t))
            return (date(1899, 12, 30 if n > 59 else 31) + timedelta(days=n)).isoformat()
    except (ValueError, KeyError, OverflowError):
        pass
    return ""


def flag(v: str | None) -> str:
    t = clean(v).casefold()
    return "true" if t in YES else "false" if t in NO else ""


#: How values of a type come out: encoder, column type, and what is added to the attribute's name.
ENCODERS: dict[str, tuple[Callable, str, str]] = {"text": (clean, "string", ""), "number": (cents, "long", "_cents"), "date": (day, "string", ""), "integer": (months, "int", ""), "boolean": (flag, "string", "")}


def _newest(slots: dict, cell: tuple) -> dict:
    have = slots.get(cell[0])
    if have is None or cell[1:] > have:
        slots[cell[0]] = cell[1:]
    return slots


def _merged(a: dict, b: dict) -> dict:
    for col, cell in b.items():
        _newest(a, (col, *cell))
    return a


REGISTER = "workbook_id string, `row` int, is_header boolean, cols array<int>, vals array<string>, found array<string>"


def slot_registers(cells: DataFrame, attrs: list[tuple[str, str]], key: str, partitions: int | None = None) -> DataFrame:
    """One row per (workbook_id, row): its columns and their newest values, and whether it is a row of headings.

    Headings are rows that name the attribute ``key`` and another one, or nothing else. Of copies of a cell the newest ``loaded_at`` holds, of equally new
    ones the greater value. Cells without a full address belong to no row and are left out; a null value counts as
    absent.
    """
    rows = cells.filter("workbook_id is not null and `row` is not null and `col` is not null and value is not null")
    n = partitions or max(2, -(-rows.count() // CELLS_PER_PARTITION))
    flat = rows.select("workbook_id", F.col("row"), F.col("col"), F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-1)), "value").rdd
    pairs = flat.map(lambda r: ((r[0], r[1]), (r[2], r[3], r[4])))
    slots = pairs.combineByKey(lambda c: {c[0]: c[1:]}, _newest, _merged, n)

    def registers(part: Iterable) -> Iterator[tuple]:
        names = Headings(attrs)
        for (wb, row), held in part:
            cols = sorted(held)
            values = [held[c][1] for c in cols]
            found = [names.find(v) for v in values]
            is_header = key in found and (len(cols) == 1 or len({*found} - {None}) > 1)
            yield wb, row, is_header, cols, values, found

    return cells.sparkSession.createDataFrame(slots.mapPartitions(registers), REGISTER, verifySchema=False)


def widen_register(cells: DataFrame, attributes: DataFrame, sheet: str = "Asset_Register", key: str = "asset_code") -> DataFrame:
    """Typed rows of every ``sheet``, one per row that holds an asset's code under the nearest headings above it.

    ``attributes`` (attr, dtype, meaning) is the fixed table that describes them and gives the columns, the key first and the others by name: numbers come out
    in hundredths with ``_cents`` behind the name, integers of months as such, dates and booleans as text. Rows of
    headings, totals and rows above the first headings have no code and give nothing; a workbook whose headings name no
    code gives nothing. Absent values, placeholders and errors are '' in text and -1 in numbers. Ties, repeats and late
    copies of cells are settled by :func:`slot_registers`; an empty table gives no rows.
    """
    described = [(r.attr, r.dtype, r.meaning) for r in attributes.select("attr", "dtype", "meaning").filter("attr is not null").collect() if r.dtype in ENCODERS]
    described = sorted({d[0]: d for d in sorted(described, key=str)}.values(), key=lambda d: (d[0] != key, d[0]))
    made = [(a, *ENCODERS[t]) for a, t, _ in described]
    columns = ["workbook_id", "row", *[a + tail for a, _, _, tail in made]]
    schema = ", ".join(["workbook_id string", "`row` int", *[f"`{a}{tail}` {kind}" for a, _, kind, tail in made]])
    regs = slot_registers(cells.filter(F.col("sheet") == sheet), [(a, m) for a, _, m in described], key)
    heads = regs.filter("is_header").groupBy("workbook_id").agg(F.collect_list(F.struct("row", "cols", "found")).alias("heads"))
    rows = regs.filter("not is_header").select("workbook_id", "row", "cols", "vals").join(heads, "workbook_id")

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for wb, row, cols, vals, above in zip(pdf.workbook_id, pdf["row"], pdf["cols"], pdf["vals"], pdf["heads"]):
                head = max((h for h in above if h["row"] < row), key=lambda h: h["row"], default=None)
                if head is None:
                    continue
                attr = {c: a for c, a in zip(head["cols"], head["found"]) if a}
                got = {attr[c]: v for c, v in zip(cols, vals) if c in attr}
                if any(ch.isdigit() for ch in clean(got.get(key))):
                    out.append((wb, row, *[f(got.get(a)) for a, f, _, _ in made]))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(encode, schema)
