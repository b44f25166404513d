"""The general problems on small fixtures, against brute force, with the awkward inputs each docstring defines."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.functions.refs import ref_rows
from gridloom.operators.hierarchy import hierarchy, sheet_hierarchy
from gridloom.operators import orphans
from gridloom.operators.orphans import orphan_references
from gridloom.operators.skew import at_task, balanced_counts, balanced_join, fragment, pack_bins, plan_shards, replicate
from gridloom.operators.units import UnitIndex, converted, edit_cost, known_spellings
from gridloom.operators.widen import Headings, cents, day, flag, months, number, widen_register
from gridloom.tables import sheet_key

T0 = datetime(2025, 1, 1)
CELL = "workbook_id string, sheet string, `row` int, col int, value string, loaded_at timestamp, extra string"
LINE = "workbook_id string, sheet string, `row` int, section string, label string, units string, loaded_at timestamp, deleted_at timestamp, value string"
SHEETS = "workbook_id string, sheet string, loaded_at timestamp, layout struct<label_col:int,units_col:int>"
EDGE = "edge_id long, workbook_id string, src_sheet string, src_row int, dst_sheet string, dst_row int, kind string, built_at timestamp, sheet string"
NAME = "name_id long, workbook_id string, name string, ref string, scope string, loaded_at timestamp, sheet string"
REFS = [("ccy", "money", "ccy_m", 1e-6), ("ccy_k", "money", "ccy_m", 1e-3), ("ccy_m", "money", "ccy_m", 1.0), ("ccy_crore", "money", "ccy_m", 10.0), ("ml", "volume", "ml", 1.0), ("kl", "volume", "ml", 1e-3),
        ("pct", "rate", "frac", 0.01), ("frac", "rate", "frac", 1.0), ("km", "length", "km", 1.0), ("m", "length", "km", 1e-3), ("month", "duration", "year", 1 / 12), ("year", "duration", "year", 1.0)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sheet_key(spark):
    names = ["'It''s'", " it's ", "IT'S", "'", "''", None]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(sheet_key(F.col("n")).alias("k")).collect()]
    assert got == ["it's", "it's", "it's", "'", "", None]


def test_intermediate_tables_go(spark):
    from gridloom.tables import materialise, path_exists, release, session_dir

    df = materialise(spark.range(3).toDF("i"))
    at = session_dir(spark)
    assert df.count() == 3 and path_exists(spark, at)
    release(spark)
    assert not path_exists(spark, at) and materialise(spark.range(2).toDF("i")).count() == 2 and session_dir(spark) != at
    release(spark)
    release(spark)


# ------------------------------------------------------------------ units


def test_unit_spellings():
    ix = UnitIndex(known_spellings([c for c, *_ in REFS]))
    for text, code in {"kilo-metres": "km", "kilometrse": "km", "megaliter": "ml", "mega litres": "ml", "kilolitr": "kl", "x " * 5000: None, "m" * 41 + " kilometres": None, "$'000": "ccy_k", "A$ (000s)": "ccy_k", "in Mio. EUR": "ccy_m", "mn $": "ccy_m", "₹ crore": "ccy_crore", " ML p.a. ": "ml", "[per cent]": "pct", "share of 1": "frac", "mega-litrs": "ml", "kilometrs": "km",
                       "FTE": None, "x": None, "": None, "score": None, "mths": "month", "single Euro": "ccy"}.items():
        assert ix.find(text) == code, text
    assert edit_cost("ab", "ba", 9) == pytest.approx(0.6) and edit_cost("a b", "ab", 9) == pytest.approx(0.3) and edit_cost("abc", "xyz", 1) > 1


def test_conversion(spark):
    line = lambda r, label, units, section=None: ("w", "S", r, section, label, units, T0, None, "clash")
    lines = [line(1, "a", "$k"), line(2, "b", "tbc", "Works - $'000"), line(3, "c (%)", None), line(4, "d", "FTE", "Works - $k"), line(5, "e", "ML"), line(6, None, None), line(1, "a", "$k"), line(7, "f in kL", "-", "Works - $k")]
    cell = lambda r, c, v, t=0: ("w", "S", r, c, v, T0 + timedelta(days=t), "x")
    cells = [cell(1, 3, "1"), cell(1, 3, "(1,234.5)", 1), cell(1, 4, "1.234,5"), cell(1, 5, "$2.5m"), cell(1, 6, "#REF!"), cell(1, 7, "2024-01-31"), cell(1, 8, None), cell(1, 9, "12 FTE"), cell(1, 2, "$k"), cell(1, 10, "−12 thousand $"),
             cell(2, 3, "5"), cell(3, 3, "8.5"), cell(4, 3, "7"), cell(5, 3, "3"), cell(5, 4, "9 000,5 kL"), cell(6, 3, "1"), cell(7, 3, "4"), cell(7, 4, "pending")]
    sheets = spark.createDataFrame([("w", "S", T0, (1, 2)), ("w", "S", T0, None)], SHEETS)
    refs = spark.createDataFrame(REFS, "unit_code string, dimension string, common_code string, factor double")
    got = rows(converted(spark.createDataFrame(cells, CELL), spark.createDataFrame(lines, LINE), sheets, refs))
    assert got == [("w", "S", 1, 3, -1234500), ("w", "S", 1, 4, 1234500), ("w", "S", 1, 10, -12000), ("w", "S", 2, 3, 5000), ("w", "S", 3, 3, 85000), ("w", "S", 5, 4, 9000500), ("w", "S", 7, 3, 4000)]
    none = converted(spark.createDataFrame([], CELL), spark.createDataFrame([], LINE), sheets.limit(0), refs)
    assert none.count() == 0


# ------------------------------------------------------------------ orphans


def test_ref_rows():
    assert ref_rows("'A b'!$C$3:$D$5") == (False, [("A b", 3, 5)])
    assert ref_rows("=X!R7C6:R9C8,'It''s'!$A$1") == (False, [("X", 7, 9), ("It's", 1, 1)])
    assert ref_rows("X!$C:$C") == (False, []) and ref_rows("=0.08") == (False, []) and ref_rows('="#REF!"') == (False, []) and ref_rows(None) == (False, [])
    assert ref_rows("X!#REF!") == (True, []) and ref_rows("'[B.xlsx]X'!$A$1") == (False, []) and ref_rows("$A$4", "Own") == (False, [("Own", 4, 4)]) and ref_rows("$A$4") == (False, [])
    assert ref_rows("=DATE(2026,6,30)") == (False, []) and ref_rows("X!$3:$4") == (False, [("X", 3, 4)])


def test_orphans_against_brute_force(spark):
    rng = random.Random(4)
    t = lambda: T0 + timedelta(days=rng.randrange(60))
    lines = []
    for _ in range(120):
        a = t()
        lines.append((rng.choice("wv"), rng.choice(["S", "It's"]), rng.randrange(12), None, None, None, a, a + timedelta(days=rng.randrange(1, 30)) if rng.random() < 0.5 else None, "x"))
    lines += [("w", "S", 1, None, None, None, None, None, None), lines[0]]
    edges = [(i, rng.choice("wv"), rng.choice(["S", "'S'", " s "]), rng.randrange(14), rng.choice(["It's", "'IT''S'"]), 3 if i % 3 else rng.randrange(14), None, t(), "x") for i in range(200)]
    edges += [edges[0], (900, "w", "S", None, None, 3, None, t(), None), (901, "w", "S", 1, "S", 1, None, None, None)]
    names = [(1, "w", "n", "S!$A$1:$B$9", None, t(), ""), (2, "w", "n", "=#REF!", None, t(), ""), (3, "w", "n", None, None, t(), ""), (4, "v", "n", "$B$2", "S", t(), ""), (4, "v", "n", "$B$2", "S", None, "")]
    have = {}
    for w, s, r, *_, a, b, _x in lines:
        if a:
            have.setdefault((w, s.lower(), r), []).append((a, b))

    def why(key, at):
        c = have.get(key)
        if not c:
            return 0
        if any(a <= at and (b is None or b > at) for a, b in c):
            return None
        return 1 if any(a <= at for a, _ in c) else 2

    k = lambda s: s.strip().strip("'").replace("''", "'").lower()
    want, words = set(), ["missing", "deleted", "late"]
    for i, w, s, r, s2, r2, _, at, _x in edges:
        for f, sh, row in (("src_row", s, r), ("dst_row", s2, r2)):
            if at and row is not None and (x := why((w, k(sh or ""), row), at)) is not None:
                want.add(("edges", i, f, words[x], f"{at:%Y-%m}"))
    for i, w, _, ref, scope, at, _x in names:
        if at:
            broken, areas = ref_rows(ref, scope)
            xs = [0] if broken else [x for s, a, b in areas for r in range(a, b + 1) if (x := why((w, k(s), r), at)) is not None]
            if xs:
                want.add(("defined_names", i, "ref", words[min(xs)], f"{at:%Y-%m}"))
    got = orphan_references(spark.createDataFrame(lines, LINE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(names, NAME))
    assert set(rows(got)) == want
    empty = orphan_references(spark.createDataFrame([], LINE), spark.createDataFrame(edges[:1], EDGE), spark.createDataFrame([], NAME))
    assert {r[3] for r in rows(empty)} == {"missing"}


def test_spans_over_several_ranges(spark, monkeypatch):
    """Spans are probed as intervals: over the ends of ranges, with holes, deleted and late rows in them."""
    monkeypatch.setattr(orphans, "ROWS_AT_ONCE", 7)
    late, gone = T0 + timedelta(days=50), T0 + timedelta(days=5)
    there = [("w", "S", r, None, None, None, T0, None, "x") for r in range(4000, 9000) if r != 4500]
    lines = [*there, ("w", "L", 10, None, None, None, late, None, "x"), ("w", "L", 11, None, None, None, T0, gone, "x"), ("w", "L", 12, None, None, None, T0, None, "x")]
    refs = ["S!$A$4501:$A$8999", "S!$A$4090:$A$4100", "S!$A$4400:$A$4600", "S!$A$8999:$A$9000", "L!$A$10:$A$12", "L!$A$10", "L!$A$11:$A$12", "L!$A$12:$C$12", "S!$A$4096:$A$4096,L!$A$10"]
    names = [(i, "w", "n", r, None, T0 + timedelta(days=9), "") for i, r in enumerate(refs)]
    got = orphan_references(spark.createDataFrame(lines, LINE), spark.createDataFrame([], EDGE), spark.createDataFrame(names, NAME))
    assert sorted((r.ref_id, r.reason) for r in got.collect()) == [(2, "missing"), (3, "missing"), (4, "deleted"), (5, "late"), (6, "deleted"), (8, "late")]


# ------------------------------------------------------------------ hierarchies


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(9)
    nodes, links = [], []
    for g in "abc":
        names = [f"{g}{i:02d}" for i in range(25)]
        nodes += [(g, n) for n in names] + [(g, names[0]), (g, None)]
        links += [(g, n, rng.choice(names)) for n in names if rng.random() < 0.85]
    nodes += [("d", f"d{i}") for i in range(6)]
    chain = [f"e{i:02d}" for i in range(30)]  # deeper than a round goes down, and a loop longer than that with a tail
    nodes += [("e", x) for x in chain] + [("f", x) for x in chain]
    links += [("e", b, a) for a, b in zip(chain, chain[1:])] + [("f", b, a) for a, b in zip(chain[:20], chain[1:20])] + [("f", chain[0], chain[11])]
    links += [("d", "d1", "d3"), ("d", "d3", "d2"), ("d", "d2", "d1"), ("d", "d0", "d1"), ("d", "d4", "d0")]
    links += [links[0], ("a", "a01", "nowhere"), ("z", "a01", "a02"), (None, "a", "b")]
    parent = {}
    for g, n, p in links:
        if g and (g, n) in nodes and (g, p) in nodes and n != p:
            parent[g, n] = min(p, parent.get((g, n), p))
    own = {x for x in nodes if x[1]}
    up, below = {}, dict.fromkeys(own, 0)
    for g, n in own:
        path, x = [n], n
        while (g, x) in parent and parent[g, x] not in path:
            x = parent[g, x]
            path.append(x)
        for a in path[1:]:
            below[g, a] += 1
        up[g, n] = (min(path[path.index(parent[g, x]) :]), -1, []) if (g, x) in parent else (x, len(path) - 1, path[::-1])
    want = sorted((g, n, *up[g, n], below[g, n]) for g, n in own)
    got = hierarchy(spark.createDataFrame(nodes, "grp string, node string"), spark.createDataFrame(links, "grp string, node string, parent string"))
    assert sorted((r.grp, r.node, r.root, r.depth, list(r.path), r.n_desc) for r in got.collect()) == want
    assert any(u[1] == -1 for u in up.values())


def test_sheet_hierarchy(spark):
    sheets = [("w", s, T0, None) for s in ("A", "B b", "C", "X", "Y", "Alone", "A")]
    e = lambda i, s, d, kind="direct": (i, "w", s, 1, d, 1, kind, T0, "clash")
    edges = [e(1, "a", "'B B'"), e(1, "a", "'B B'"), e(2, "B b", "C", None), e(3, "C", "Alone", " INACTIVE"), e(4, "X", "Y"), e(5, "Y", "X"), e(6, "A", "A"), e(7, "Gone", "Alone"), e(8, "A", None)]
    got = rows(sheet_hierarchy(spark.createDataFrame(sheets, SHEETS), spark.createDataFrame(edges, EDGE)))
    assert got == [("w", "A", "A", 0, "A", 2), ("w", "Alone", "Alone", 0, "Alone", 0), ("w", "B b", "A", 1, "A > B b", 1), ("w", "C", "A", 2, "A > B b > C", 0), ("w", "X", "X", -1, "", 1), ("w", "Y", "X", -1, "", 1)]
    assert sheet_hierarchy(spark.createDataFrame([], SHEETS), spark.createDataFrame([], EDGE)).count() == 0


# ------------------------------------------------------------------ skew


def test_balanced(spark):
    data = [("hot", i, "x") for i in range(700)] + [(f"k{i % 40}", i, "x") for i in range(300)] + [(None, i, None) for i in range(30)]
    df = spark.createDataFrame(data, "key string, id int, n_rows string")
    got = {r.key: r.n_rows for r in balanced_counts(df, ["key"], ["id"], tasks=8).collect()}
    want: dict = {}
    for k, *_ in data:
        want[k] = want.get(k, 0) + 1
    assert got == want
    plan = plan_shards(df, ["key"], 8)
    assert plan.heavy_keys == 1 and [len(v) for v in plan.shards.values()] == [6]
    for side in (fragment(df, plan, ["id"]), replicate(df, plan)):  # the packing decides where rows are
        assert at_task(side, plan).filter(F.spark_partition_id() != F.col("task")).count() == 0
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "key string, id int")
    plain = df.join(right.withColumnRenamed("id", "id_r"), "key", "left")
    assert sorted(map(str, balanced_join(df, right, ["key"], ["id"], "left", 8).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert balanced_counts(df.limit(0), ["key"], ["id"]).count() == 0
    assert pack_bins([(0, 5), (1, 4), (2, 3), (3, 3)], 2, [0, 0]) in ([0, 1, 1, 0], [0, 1, 0, 1], [0, 1, 1, 0])


# ------------------------------------------------------------------ registers


def test_encoders():
    assert [cents(x) for x in ("1,234.50", "1.234,50 €", "$ 99", "(12.5)", "1 954 586.94", "tbc", "#N/A", None, "1,234", "1.345.801,00", "-7")] == [123450, 123450, 9900, -1250, 195458694, -1, -1, -1, 123400, 134580100, -700]
    assert number("2,5") == number("2.5") and number("abc") is None
    assert [day(x) for x in ("2020-1-5", "2020/01/05 00:00", "05.01.2020", "5 Jan 2020", "05-Mai-2020", "43835", "59", "31.02.2020", "?", "1")] == ["2020-01-05", "2020-01-05", "2020-01-05", "2020-01-05", "2020-05-05", "2020-01-05", "1900-02-28", "", "", "1900-01-01"]
    assert [months(x) for x in ("36", " 60.0", "84m", "240 months", "12 mths", "2 years", "-", None)] == [36, 60, 84, 240, 12, 24, -1, -1]
    assert [flag(x) for x in ("Yes ", "0", "nein", "TRUE", "?", None)] == ["true", "false", "false", "true", "", ""]


ATTRS = [("site", "text", "where it stands"), ("asset_code", "text", "code of the asset"), ("asset_class", "text", "kind of asset"), ("cost", "number", "what it cost"), ("insured", "number", "value insured"),
         ("in_service", "date", "first day of use"), ("life_months", "integer", "useful life in months"), ("active", "boolean", "in use or not"), ("active", "boolean", "in use or not"), (None, "text", None), ("odd", "blob", "?")]


@pytest.mark.parametrize(("heading", "attr"), [
    ("Anlagennummer", "asset_code"), ("Kategorie", "asset_class"), ("Lieu", "site"), ("Prix d'achat", "cost"), ("Kaufpreis", "cost"), ("Valeur assurée", "insured"), ("Versicherungssumme", "insured"), ("Start date:", "in_service"), ("Nutzungsbeginn", "in_service"),
    ("Lifetime in months", "life_months"), ("Vida útil (meses)", "life_months"), ("still_in_use ?", "active"), ("Operational", "active"), ("Standort der Anlage", "site"),
    ("Remark", None), ("Insured by", None), ("Audit date", None), ("Warranty months", None), ("Book value", None), ("No", None), ("no", None), ("Code 7", None), ("", None), (None, None), ("x " * 5000, None), ("code" * 5000, None),
])
def test_headings(heading, attr):
    assert Headings([(a, m) for a, t, m in ATTRS if a and t != "blob"]).find(heading) == attr


def test_widen(spark):
    c = lambda r, k, v, t=0, w="w": (w, "Asset_Register", r, k, v, T0 + timedelta(days=t), "x")
    cells = [c(1, 1, "Register"), c(3, 1, "Asset code:"), c(3, 2, " COST"), c(3, 3, "Remark"), c(3, 4, "Aktiv"), c(4, 1, "AB-1 "), c(4, 2, "old"), c(4, 2, "12.5", 2), c(4, 2, "older", 1), c(4, 4, "ja"), c(5, 1, "Total"), c(5, 2, "99"),
             c(6, 1, "Asset code"), c(6, 2, "Cost"), c(6, 4, "Aktiv"), c(7, 1, " 100001"), c(7, 2, "n/a"), c(7, 3, "note"), c(7, 4, None), c(8, 2, "5"), c(4, 1, "AB-1 "), c(2, 1, "AB-9"), c(4, 1, "Z-1", 0, "v"), (None, "Asset_Register", 4, 1, "Q-1", T0, ""), ("w", "Other", 4, 1, "Q-1", T0, "")]
    attrs = spark.createDataFrame(ATTRS, "attr string, dtype string, meaning string")
    order = ["workbook_id", "row", "asset_code", "asset_class", "site", "cost_cents", "insured_cents", "in_service", "life_months", "active"]
    got = rows(widen_register(spark.createDataFrame(cells, CELL), attrs).select(*order))
    assert got == [("w", 4, "AB-1", "", "", 1250, -1, "", -1, "true"), ("w", 7, "100001", "", "", -1, -1, "", -1, "")]
    assert widen_register(spark.createDataFrame([], CELL), attrs).count() == 0
    fewer = widen_register(spark.createDataFrame(cells, CELL), attrs.filter("attr in ('asset_code', 'cost')"))
    assert fewer.columns == ["workbook_id", "row", "asset_code", "cost_cents"] and rows(fewer) == [("w", 4, "AB-1", 1250), ("w", 7, "100001", -1)]
