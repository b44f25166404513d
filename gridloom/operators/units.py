"""Quantities written in different units and scales, brought to the common unit of their dimension.

The distinct spellings of units (in cells, units columns, labels and sections) are few beside the rows. They are
mapped once: an inverted index of character n-grams proposes known spellings, a weighted edit distance verifies
them. The alias dictionary that results is joined to all rows, and figures are read by JVM expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.tables import BLANK, BLANKS, broadcast_if_small, materialise, sheet_key, trimmed

#: Known spellings per unit code, in the folded form of :func:`fold`: marks, and names in one form each; plurals, other
#: endings and slips of names are the edit distance's. Money is spelled by rule in :func:`money_spellings`.
SPELLINGS = {
    "l": "l|litre|liter|litres|liters",
    "kl": "kl|kilolitre|000 l|thousand litres",
    "m3": "m3|cu m|cbm|cubic metre|kubikmeter|metres cubes",
    "ml": "ml|megalitre|million litres",
    "gl": "gl|gigalitre|000 ml|thousand ml|thousand megalitres",
    "acre_ft": "acre ft|ac ft|ac-ft|af|acre feet|acre foot",
    "mgal_us": "us mgal|mgal us|mgal (us)|million us gal|million us gallons|million gallons us",
    "kwh": "kwh|kw.h|kilowatt hour|kilowattstunden",
    "mwh": "mwh|mw.h|megawatt hour|megawattstunden",
    "gwh": "gwh|gw.h|gigawatt hour|gigawattstunden",
    "gj": "gj|gigajoule",
    "mmbtu": "mmbtu|million btu|mm btu",
    "m": "m|metre|meter|metres|meters|running metres|lin. m|lin m|lfm|linear metres",
    "km": "km|kilometre",
    "mi": "mi|mile|miles|statute miles",
    "kg": "kg|kilogram|kilogramme|kgs",
    "t": "t|tonne|tonnes|tonnen|metric ton|metric tonnes",
    "kt": "kt|kilotonne|000 t|thousand tonnes|000 tonnes|thousand t",
    "lb": "lb|lbs|pound (weight)|pounds weight",
    "short_ton": "short ton|us ton|us tons",
    "frac": "fraction|decimal|share of 1|frac|anteil",
    "pct": "%|percent|pct|prozent|pour cent|percentage",
    "bps": "bps|bp|b.p.|basis point|basispunkte",
    "year": "y|yr|yrs|year|years|jahr|jahre|ans|annees",
    "quarter": "q|qtr|qtrs|quarter|quartale|trimestres",
    "month": "mo|mos|mth|mths|month|months|monat|monate|mois",
}
CURRENCIES = ["$", "a$", "us$", "€", "£", "₹", "aud", "usd", "eur", "euro", "euros", "gbp", "inr", "rs", "rs.", "dollar", "dollars", "rupees"]
SCALES = {
    "ccy": ["", "whole", "single", "units of", "plain"],
    "ccy_k": ["k", "000", "000s", "(000s)", "thousand", "thousands", "thousands of", "tsd.", "tsd", "t", "thou"],
    "ccy_m": ["m", "mm", "mn", "mio.", "mio", "mill", "million", "millions", "millions of"],
    "ccy_bn": ["bn", "b", "mrd.", "mrd", "billion", "billions", "billions of"],
    "ccy_lakh": ["lakh", "lakhs", "lac", "lacs", "l"],
    "ccy_crore": ["crore", "crores", "cr", "cr."],
}
PRICES = {"ccy_per_kl": ("money", ["kl", "m3", "cu m", "cbm", "kilolitre", "cubic metre"]), "ccy_per_ml": ("money", ["ml", "megalitre"]), "cent_per_kl": ("cent", ["kl", "m3", "kilolitre", "cubic metre"])}
CENTS = ["c", "ct", "cent", "cents", "¢"]
#: What stands in a units column in place of a unit; the next text is then looked at.
PLACEHOLDERS = ["", "-", "--", "tbc", "tbd", "n/a", "na", "?", "n.a."]
#: Spellings shorter than this must agree letter by letter, as one edit makes another unit of them; the most edits a letter.
FUZZY_FROM, FUZZY_MOST = 6, 0.17


def fold(text: str) -> str:
    """Compatibility form, case folded, quotes dropped, blanks single; outer brackets, leading "in" and per-year tags go."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    t = re.sub(r"['’‘`´\"]", "", t)
    t = re.sub(r"\s+", " ", t).strip()
    for _ in range(3):
        t = re.sub(r"^in (?=\S)", "", t).strip()
        if len(t) > 1 and (t[0], t[-1]) in (("(", ")"), ("[", "]"), ("{", "}")) and t[1:-1].count(t[0]) == t[1:-1].count(t[-1]):
            t = t[1:-1].strip()
        t = re.sub(r"(?:\s*/\s*(?:yr|year|y|a|annum|jahr|an)|[\s,]+(?:p\.\s?a\.?|pa|per (?:year|annum)|yearly|annually|pro jahr|par an))$", "", t).strip()
    return t


def money_spellings() -> Iterator[tuple[str, str]]:
    """Currency and scale in either order, with and without a blank; marks of one letter only beside the currency."""
    for code, scales in SCALES.items():
        for s in scales:
            for c in CURRENCIES:
                words = [c] if not s else [f"{s} {c}", f"{c} {s}", f"{s}{c}", f"{c}{s}"]
                if s == "l" or (s == "t" and c not in ("€", "eur", "euro")):
                    continue
                yield from ((w, code) for w in words)


def known_spellings(codes: Iterable[str]) -> dict[str, str]:
    """Folded spelling -> unit code, of the codes given; the code itself is a spelling too."""
    codes = set(codes)
    out = {fold(c.replace("_", " ")): c for c in codes}
    out |= {w: c for c, ws in SPELLINGS.items() if c in codes for w in map(fold, ws.split("|"))}
    out |= {fold(w): c for w, c in money_spellings() if c in codes}
    for code, (kind, volumes) in PRICES.items():
        tops = CENTS if kind == "cent" else CURRENCIES
        if code in codes:
            out |= {fold(f"{t}{by}{v}"): code for t in tops for v in volumes for by in ("/", " per ", " / ")}
    return out


def grams(t: str, n: int = 3) -> set[str]:
    t = f"  {t} "
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def _weights(t: str) -> tuple[list[float], list[float]]:
    """What a letter costs to exchange, and to drop or add where it stands."""
    w = [0.3 if c in " -.,_" else 3.0 if c.isdigit() else 1.0 for c in t]
    return w, [0.6 if i and t[i - 1] == c else x for i, (c, x) in enumerate(zip(t, w))]


def edit_cost(a: str, b: str, most: float) -> float:
    """Weighted edit distance with neighbouring letters exchanged; ``most`` ends it early.

    Blanks, hyphens and dots cost 0.3, doubled letters and exchanges 0.6, any other edit 1; digits cost 3.
    """
    if a == b:
        return 0.0
    wa, da = _weights(a)
    wb, db = _weights(b)
    before: list[float] = []
    row = [0.0]
    for x in wb:
        row.append(row[-1] + x)
    last = ""
    for i, x in enumerate(a):
        older, before = before, row
        cost, drop = wa[i], da[i]
        left = before[0] + cost
        row = [left]
        least = left
        prev = ""
        for j, y in enumerate(b):
            if x == y:
                best = before[j]
            else:
                k = wb[j]
                best = before[j] + (cost if cost > k else k)
                if prev == x and last == y and older[j - 1] + 0.6 < best:
                    best = older[j - 1] + 0.6
            up = before[j + 1] + drop
            if up < best:
                best = up
            left += db[j]
            if left < best:
                best = left
            row.append(best)
            left = best
            if best < least:
                least = best
            prev = y
        if least > most:
            return most + 1
        last = x
    return row[-1]


class UnitIndex:
    """Inverted index from character n-grams to known spellings."""

    def __init__(self, spellings: dict[str, str]) -> None:
        self.spellings = spellings
        self.keys = list(spellings)
        self.sizes = [len(grams(k)) for k in self.keys]
        self.post: dict[str, list[int]] = defaultdict(list)
        for i, k in enumerate(self.keys):
            for g in grams(k):
                self.post[g].append(i)

    def find(self, text: str) -> str | None:
        """The unit code of the closest spelling within the distance allowed, None if several codes are equally close."""
        t = fold(text)
        if t in self.spellings:
            return self.spellings[t]
        if len(t) < FUZZY_FROM:
            return None
        shared: dict[int, int] = defaultdict(int)
        own = grams(t)
        for g in own:
            for i in self.post.get(g, ()):
                shared[i] += 1
        most = FUZZY_MOST * len(t)
        best, codes = most, set()
        for i, n in shared.items():
            k = self.keys[i]
            if len(k) < FUZZY_FROM or 2 * n < 0.4 * (len(own) + self.sizes[i]):
                continue
            d = edit_cost(t, k, best)
            if d < best or d == best and d <= most:
                codes = codes | {self.spellings[k]} if d == best else {self.spellings[k]}
                best = d
        return codes.pop() if len(codes) == 1 else None


def alias_dictionary(spellings: DataFrame, unit_refs: DataFrame) -> DataFrame:
    """Of distinct ``spelling`` values those that name a unit: spelling, unit_code, common_code, factor.

    ``unit_refs`` is the fixed list of canonical units (some dozens of rows) and is what the index is built from.
    """
    refs = unit_refs.filter("unit_code is not null").dropDuplicates(["unit_code"])
    codes = sorted(r[0] for r in refs.select("unit_code").collect())

    def match(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = UnitIndex(known_spellings(codes))
        for pdf in batches:
            code = [index.find(x) for x in pdf.spelling]
            yield pdf.assign(unit_code=code).dropna()

    found = spellings.select("spelling").dropna().distinct().mapInPandas(match, "spelling string, unit_code string")
    return found.join(F.broadcast(refs.select("unit_code", "common_code", "factor")), "unit_code")


# Figures. A number may be wrapped in unit marks; what is left around it is the unit's spelling.
_NUM = r"[-−–+]?\s*(?:\d[\d.,'’" + BLANK[1:-1] + r" ]*\d|\d|\.\d+)(?:[eE][-+]?\d+)?"
PLAIN = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"
AROUND = rf"(?s)^([^\d(\-−–+.]*)(\(?\s*{_NUM}\s*-?\)?)(\D.*)?$"


#: Stands between the parts of a value once they are told apart; in a cell it counts as a blank.
_CUT = "\x01"


def _parted(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_plain`` (a bare number), ``_figure`` and ``_rest``: the figure of any other value and what stands around it.

    Each step is a column of its own, as composed expressions would be evaluated once for every mention of them.
    """
    out = df.withColumn("_plain", F.col(value).rlike(PLAIN))
    held = ~F.col("_plain") & F.col(value).rlike(r"\d") & ~F.col(value).rlike(r"^\s*#|^\s*\d{4}-\d\d-\d\d")
    out = out.withColumn("_p", F.when(held, F.split(F.regexp_replace(F.translate(value, _CUT, " "), AROUND, f"$1{_CUT}$2{_CUT}$3"), _CUT)))
    out = out.withColumn("_p", F.when(F.size("_p") == 3, F.col("_p")))
    return out.withColumn("_figure", F.col("_p")[1]).withColumn("_rest", F.nullif(trimmed(F.concat(F.col("_p")[0], F.col("_p")[2])), F.lit(""))).drop("_p")


def _held(col: Column) -> Column:
    """The column, with a condition on the partition's number that is always true: it keeps later filters above the steps
    the column is made in. Pushed below they would hold all of them, each written out once for every mention."""
    return F.when(F.spark_partition_id() >= 0, col)


def cell_units(df: DataFrame, value: str, unit: str) -> DataFrame:
    """Adds the text around the figure of ``value`` as ``unit``; null where nothing but a number stands there."""
    return _parted(df, value).withColumn(unit, _held(F.col("_rest"))).drop("_plain", "_figure", "_rest")


def cell_figures(df: DataFrame, value: str, number: str, unit: str) -> DataFrame:
    """Adds ``number``, the figure of ``value`` in the notations of accounts, and ``unit``, the text around it."""
    out = _parted(df, value).withColumnRenamed("_rest", unit)
    out = out.withColumn("_n", F.translate("_figure", BLANKS + "'’", ""))
    first = F.substring("_n", 1, 1)
    out = out.withColumn("_neg", first.isin("-", "−", "–") | F.endswith("_n", F.lit("-")) | (first == "(") & F.endswith("_n", F.lit(")")))
    # signs and brackets go, but for the sign of an exponent
    out = out.withColumn("_n", F.regexp_replace("_n", r"[()+\-−–](?![0-9]+$)|^[-−–+]", ""))
    out = out.withColumn("_dot", F.instr("_n", F.lit("."))).withColumn("_comma", F.instr("_n", F.lit(",")))
    mirror = F.reverse("_n")
    comma_last = (F.col("_dot") < F.col("_comma")) & (F.instr(mirror, F.lit(",")) < F.instr(mirror, F.lit(".")))
    both, swap = (F.col("_dot") > 0) & (F.col("_comma") > 0), F.translate("_n", ",.", ".")
    one_comma = F.col("_n").rlike(r"^[0-9]*,[0-9]*$") & ~F.col("_n").rlike(r"^[1-9][0-9]{0,2},[0-9]{3}$")
    text = (
        F.when(both, F.when(comma_last, swap).otherwise(F.translate("_n", ",", ""))).when(F.col("_comma") > 0, F.when(one_comma, swap).otherwise(F.translate("_n", ",", "")))
        .when(F.col("_n").rlike(r"\..*\."), F.translate("_n", ".", "")).otherwise(F.col("_n"))
    )
    out = out.withColumn("_x", text.try_cast("double"))
    got = F.when(F.col("_plain"), F.col(value).try_cast("double")).otherwise(F.when(F.col("_neg"), -F.abs("_x")).otherwise(F.col("_x")))
    return out.withColumn(number, _held(got)).drop("_plain", "_figure", "_n", "_neg", "_dot", "_comma", "_x")


def flat_text(text: Column) -> Column:
    """The text with every kind of blank as a blank and none outside; what :func:`text_candidates` reads."""
    return F.btrim(F.translate(text, BLANKS, " " * len(BLANKS)))


def text_candidates(flat: Column) -> list[Column]:
    """Where a label or section may hold a unit, last place first: outer brackets at the end, after " in ", a comma, a dash."""
    found = [r"[(\[]([^()\[\]]+(?:\([^()]*\))?)[)\]]$", r"^.*[^,]\s(?:in|IN|In)\s+(\S.*)$", r"^.*\S,\s+(\S[^,]*)$", r"^.*\s[-–]\s+(\S.*)$", r"^.*[(\[]([^()\[\]]+)[)\]].*$"]
    return [F.regexp_extract(flat, p, 1) for p in found]


def line_units(lines: DataFrame, alias: DataFrame, small: int) -> DataFrame:
    """The unit written for each line: in its units, else its label, else its section; one row per line.

    A units text that is no placeholder and no known unit ends the search: the line has no unit of the list. Copies of a
    line that differ are settled by the newest loaded copy. Every place that may hold a unit is a row with its rank, so the
    dictionary is joined once; the rows of a line stay in its partition, and its least rank with a unit wins.
    """
    keys = ["workbook_id", "k", "row"]
    one = lines.filter("workbook_id is not null and sheet is not null and `row` is not null").groupBy("workbook_id", sheet_key(F.col("sheet")).alias("k"), "row").agg(
        F.max_by(F.struct("sheet", "units", "label", "section"), F.struct("loaded_at", "units", "label", "section")).alias("x")
    )
    one = one.select(*keys, F.col("x.sheet").alias("sheet"), trimmed(F.col("x.units")).alias("units"), flat_text(F.col("x.label")).alias("label"), flat_text(F.col("x.section")).alias("section"))
    stated = F.col("units").isNotNull() & ~F.lower("units").isin(PLACEHOLDERS)
    places = F.when(stated, F.array("units")).otherwise(F.array(*text_candidates(F.col("label")), *text_candidates(F.col("section"))))
    each = one.select(*keys, "sheet", F.posexplode_outer(F.array_remove(places, "")).alias("rank", "spelling"))
    a = alias.select("spelling", F.struct("unit_code", "common_code", "factor").alias("unit"))
    met = each.join(broadcast_if_small(a, small), "spelling", "left")
    best = F.min(F.when(F.col("unit").isNotNull(), F.struct("rank", "unit")))
    return met.groupBy(*keys).agg(F.first("sheet").alias("sheet"), best.alias("b")).select(*keys, "sheet", F.col("b.unit").alias("unit"))


def spellings_of(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct texts that may be units, gathered with map-side combination."""
    units = lines.select(trimmed(F.col("units")).alias("spelling"))
    texts = lines.select(F.explode(F.array("label", "section")).alias("t")).distinct().select(flat_text(F.col("t")).alias("t"))
    around = texts.select(F.explode(F.array(*text_candidates(F.col("t")))).alias("spelling"))
    inside = cell_units(cells.select("value"), "value", "spelling").select("spelling")
    return units.unionByName(around).unionByName(inside).filter(F.col("spelling").rlike(r"[\p{L}\p{Sc}%]")).distinct()


def common_quantities(cells: DataFrame, lines: DataFrame, sheets: DataFrame, unit_refs: DataFrame) -> DataFrame:
    """Every quantity of a line in its common unit: workbook_id, sheet, row, col, unit_code, common_code, common_value.

    Quantities are the numbers, or texts that hold one, right of the units column. The unit written nearest counts:
    in the cell, else that of the line (see :func:`line_units`); a cell whose own unit text is unknown has none.
    Of copies of a cell the newest holds, of equally new ones the greater value. Rows without a full address, lines
    without a unit of the list, dates, errors and texts without a number give nothing, empty tables give no rows.
    """
    alias = materialise(alias_dictionary(spellings_of(cells, lines), unit_refs))
    n_alias = alias.count()
    unit = line_units(lines, alias, n_alias)
    right = sheets.filter("workbook_id is not null and sheet is not null").groupBy("workbook_id", sheet_key(F.col("sheet")).alias("k")).agg(
        F.max(F.coalesce(F.col("layout.units_col"), F.col("layout.label_col") + 1)).alias("units_col")
    )
    unit = unit.join(right, ["workbook_id", "k"], "left")
    # one exchange and one sort serve both the choice of the newest copy and the join: a hash leads the keys
    lead = F.xxhash64("workbook_id", "k", "row").alias("h")
    keys = ["h", "workbook_id", "k", "row"]
    flat = cells.filter("value is not null and `col` is not null").select("workbook_id", sheet_key(F.col("sheet")).alias("k"), "row", "col", "value", "loaded_at")
    flat = flat.select(lead, "*").repartition(*keys)
    newest = flat.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "col").orderBy(F.desc("loaded_at"), F.desc("value")))).filter("n = 1")
    newest = newest.join(unit.select(lead, "*").repartition(*keys), keys).filter(F.col("col") > F.coalesce("units_col", F.lit(0)))
    got = cell_figures(newest, "value", "number", "cell_unit")
    own = alias.select(F.col("spelling").alias("cell_unit"), F.struct("unit_code", "common_code", "factor").alias("own"))
    got = got.join(broadcast_if_small(own, n_alias), "cell_unit", "left")
    got = got.withColumn("u", F.when(F.col("cell_unit").isNotNull(), F.col("own")).otherwise(F.col("unit"))).filter("number is not null and u is not null")
    return got.select("workbook_id", "sheet", "row", "col", "u.unit_code", "u.common_code", (F.col("number") * F.col("u.factor")).alias("common_value"))


def converted(cells: DataFrame, lines: DataFrame, sheets: DataFrame, unit_refs: DataFrame) -> DataFrame:
    """The quantities recorded in another than the common unit, in millionths of the common unit; one row a cell."""
    q = common_quantities(cells, lines, sheets, unit_refs).filter("unit_code <> common_code")
    return q.select("workbook_id", "sheet", "row", "col", F.round(F.col("common_value") * 1_000_000).cast("long").alias("common_micro"))
