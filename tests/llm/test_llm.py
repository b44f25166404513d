"""The text operators on small fixtures: brute force, exact round trips, held-out accuracy, awkward inputs."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.language import LANGS, SEEDS, label_code, language_segments, sentences, train, windows, wrong_labels
from gridloom.llm.packing import pack_documents, pack_summary, sum_of_squares
from gridloom.llm.tokens import VOCABULARIES, class_table, encode, encode_texts, merger, piece_offsets, scan_states, slices, NEXT
from gridloom.llm import vocab as vocab_module
from gridloom.llm.vocab import Canon, abbreviates, map_labels, map_lines
from heldout_labels import NAMED, NOTHING

TABLES = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, ids string"
needs_files = pytest.mark.skipif(not os.path.exists(f"{VOCABULARIES}/byte_bpe_50k.tiktoken"), reason="no vocabularies here")

VOCAB = [(1, "toll_income", "toll income | toll receipts"), (2, "water_tariff", "water tariff | volumetric charge"), (3, "senior_loan", "senior loan | term facility outstanding"), (4, "insurance_cost", "insurance premiums | cover premiums"),
         (5, "mains_length", "mains length | pipe network length"), (6, "company_tax", "company tax | profits tax"), (7, "wear_charge", "depreciation | wear charge")]
UNITS = ["ccy", "ccy_k", "ccy_m", "km", "m", "pct"]


# ------------------------------------------------------------------ labels


@pytest.mark.parametrize(("label", "role"), [
    ("Toll receipts", 1), ("1.5 toll_income ($ million)", 1), ("ｔｏｌｌ　ｉｎｃｏｍｅ", 1), ("income, toll", 1), ("tollincome in $k", 1), ("T0ll lncome", 1), ("Mauteinnahmen", 1), ("less: Wassertarif", 2), ("Prix de l’eau", 2), ("term facility o/s", 3), ("of which: insur. prem. p.a.", 4),
    ("pipe nwtk length, km", 5), ("longueur des conduites - base case", 5), ("depn", 7), ("insurance renewal date", 0), ("company tax file check", 0), ("toll plaza count", 0), ("period end", 0), ("12.5", 0), ("???", 0), ("x" * 5000, 0), ("toll" * 2000, 0), ("zebra " * 3000, 0), ("toll income " * 2000, 1),
])
def test_label(label, role):
    assert Canon(VOCAB, {}, UNITS).find(label)[0] == role


def test_longest_mention_wins():
    canon = Canon([(1, "a", "water"), (2, "b", "water tariff"), (3, "c", "tariff")], {}, [])
    assert [k for _, _, k in canon.mentions(["water", "tariff"])] == ["watertariff"]
    assert canon.find("water tariff")[0] == 2 and canon.find(None)[0] == 0 and Canon([], {}, []).find("water")[0] == 0


def test_short_forms():
    assert abbreviates("o/s", "outstanding") and abbreviates("ntwk", "network") and not abbreviates("w", "water") and not abbreviates("twr", "water") and not abbreviates("water", "water")
    assert Canon(VOCAB, {}, UNITS).find("insr prem")[0] == 4


def test_further_wordings_are_a_parameter():
    assert Canon(VOCAB, {}, []).find("gate money")[0] == 0 and Canon(VOCAB, {"toll_income": "gate money"}, []).find("gate money")[0] == 1


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables here")
def test_words_that_many_entries_share_name_none(spark):
    rows = spark.read.parquet(f"{TABLES}/role_vocab.parquet").collect()
    canon = Canon([(r.role_id, r.role_name, r.vocab, r.what) for r in rows], {}, UNITS)
    assert [w for w in ("water", "power", "loan", "tax", "network", "debt", "cost", "capital", "volume", "pipes", "clients", "results", "assets") if canon.find(w)[0]] == []


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables here")
def test_wordings_that_stand_in_no_list(spark):
    """Recall and false hits on wordings that neither the tables nor the lexicon hold."""
    rows = spark.read.parquet(f"{TABLES}/role_vocab.parquet").collect()
    canon = Canon([(r.role_id, r.role_name, r.vocab, r.what) for r in rows], {}, UNITS)
    name = {r.role_id: r.role_name for r in rows}
    want = [(w, role) for role, ws in NAMED.items() for w in ws]
    got = [name.get(canon.find(w)[0]) == role for w, role in want]
    assert sum(got) >= 0.95 * len(want)
    assert sum(canon.find(w)[0] > 0 for w in NOTHING) <= 0.02 * len(NOTHING)


def test_hot_labels_are_joined_in_shards(spark, monkeypatch):
    """The way beyond the bound of the broadcast gives the same rows."""
    vocab = spark.createDataFrame([(i, n, v) for i, n, v in VOCAB], "role_id int, role_name string, vocab string")
    units = spark.createDataFrame([(u,) for u in UNITS], "unit_code string")
    lines = spark.createDataFrame([("w", "S", i, "toll income" if i % 3 else f"depreciation {i} km") for i in range(300)], "workbook_id string, sheet string, `row` int, label string")
    few = sorted(map(tuple, map_lines(lines, vocab, units).collect()))
    monkeypatch.setattr(vocab_module, "FEW_LABELS", 0)
    assert sorted(map(tuple, map_lines(lines, vocab, units).collect())) == few and len(few) == 300


def test_map_lines(spark):
    schema = "workbook_id string, sheet string, `row` int, label string, role_id int"
    lines = [("w", "S", 1, "Toll income", 9), ("w", "S", 1, "Toll income", 9), ("w", "S", 2, None, 9), ("w", "S", 3, "   ", 9), ("w", "S", 4, "scenario switch", 9), (None, None, None, "toll receipts", None)]
    vocab = spark.createDataFrame([(i, n, v, "x") for i, n, v in VOCAB], "role_id int, role_name string, vocab string, label string")
    units = spark.createDataFrame([(u,) for u in UNITS], "unit_code string")
    df = spark.createDataFrame(lines, schema)
    assert sorted(map(str, map_lines(df, vocab, units).collect())) == sorted(map(str, [r for r in spark.createDataFrame([("w", "S", 1, 1), ("w", "S", 4, 0), (None, None, None, 1)], "workbook_id string, sheet string, `row` int, role_id int").collect()]))
    assert map_labels(df.limit(0), vocab, units).count() == 0


# ------------------------------------------------------------------ tokens


ODD = ["", "it's 'llama'd've''s", "'" * 70, " " * 3000, "x" * 4000, "a\0b\0", "tab\t\n \r\n  x", "<|endoftext|>", "٣²ⅷ ǅ ß\x85\x1c　é́", "🙂🙂 'S 'll", None]


def _texts(n=1500):
    rng = random.Random(3)
    letters = [*"ab'slldmtvre  \n\t12é你🙂.,-…　", "'s", "'ll", " "]
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(n)] + ODD


@needs_files
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = _texts()
    assert encode_texts(texts) == [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    m = merger()
    assert all(m.decode(i).decode() == (x or "") for i, x in zip(encode_texts(texts), texts))
    assert all(m._few(p) == m._many(p) for p in (b"hello world", b"aaaaaaaaaaaaaaaaaaaaaaa", "größte".encode(), bytes(range(256))))


def test_pieces_equal_a_regular_expression():
    import regex

    pattern = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    texts = [t or "" for t in _texts()]
    pieces, counts, at = slices(texts)
    want = [p.encode() for t in texts for p in pattern.findall(t)]
    assert pieces == want and counts.sum() == len(want)
    ends = np.cumsum(counts)
    for t, lo, hi in zip(texts, ends - counts, ends):
        assert all(t.encode()[a : a + len(p)] == p for p, a in zip(pieces[lo:hi], at[lo:hi]))


def test_scan_is_independent_of_lanes():
    kinds = np.random.default_rng(0).integers(0, 8, 997).astype(np.uint8)
    state, want = 0, []
    for k in kinds:
        want.append(state)
        state = NEXT[k, state]
    assert all((scan_states(kinds, lanes) == want).all() for lanes in (1, 7, 997, 4096))
    assert class_table()[0x3000] == class_table()[ord(" ")]


@needs_files
def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "Hello there", None, "x"), (2, None, None, "x"), (3, "", "en", None), (1, "Hello there", None, "x")], DOC)
    got = sorted((r.doc_id, list(r.ids)) for r in encode(df).collect())
    assert got == [(1, [15496, 612]), (1, [15496, 612]), (2, []), (3, [])]
    assert encode(df.limit(0)).count() == 0
    assert sorted((r.n_pieces, list(r.offsets)) for r in piece_offsets(df).filter("doc_id < 3").collect())[0] == (0, [])


# ------------------------------------------------------------------ packing


def _by_hand(sizes, cap):
    """Sum-of-squares packing by trying every level and adding up the squares."""
    level, bins, out = {}, [], []
    for s in sizes:
        best = None
        for h in [0, *sorted(k for k, v in level.items() if v)]:
            if h + s > cap:
                continue
            new = dict(level)
            if h:
                new[h] -= 1
            if h + s < cap:
                new[h + s] = new.get(h + s, 0) + 1
            cost = sum(v * v for v in new.values())
            if best is None or cost <= best[0]:
                best = (cost, h, new)
        _, h, level = best
        if h:
            i = max(i for i, f in enumerate(bins) if f == h)
            bins[i] += s
        else:
            i = len(bins)
            bins.append(s)
        out.append(i)
    return bins


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    for cap in (1, 5, 12):
        sizes = rng.integers(1, cap + 1, 150)
        got = sum_of_squares(sizes, cap)
        fill = np.bincount(got, weights=sizes)
        assert fill.max() <= cap and sorted(fill.tolist()) == sorted(map(float, _by_hand(sizes.tolist(), cap)))


def test_pack_documents(spark):
    rng = np.random.default_rng(2)
    counts = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 800))] + [(5000, 1000), (5001, None), (5002, 100), (5002, 100), (None, 3)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens int")
    packs = spark.createDataFrame([(1, "a", 100), (2, "b", 512), (3, "none", 0), (4, "null", None)], "pack_id int, pack_name string, capacity_tokens int")
    out = pack_documents(df, packs, per_shard=200).cache()
    cap = {1: 100, 2: 512}
    fill, total = {}, {}
    for r in out.collect():
        total[r.pack_id, r.doc_id] = total.get((r.pack_id, r.doc_id), 0) + r.tokens
        if r.container is not None:
            fill[r.pack_id, r.container] = fill.get((r.pack_id, r.container), 0) + r.tokens
        assert (r.container is None) == (r.tokens == 0)
    want = dict(counts)
    want[5001] = 0
    assert total == {(p, d): n for p in cap for d, n in want.items() if d is not None} and all(v <= cap[p] for (p, _), v in fill.items())
    pieces = {(r.pack_id, r.doc_id): r.n for r in out.groupBy("pack_id", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert pieces[1, 5000] == 10 and pieces[2, 5000] == 2 and all(n == 1 for (p, d), n in pieces.items() if want[d] <= cap[p])
    assert all(r.used > 0.93 for r in pack_summary(out, packs).collect())
    assert pack_documents(df.limit(0), packs).count() == 0


# ------------------------------------------------------------------ languages


PARTS = {
    "en": (["the report", "this sheet", "our model", "the new pump"], ["shows that", "does not explain why", "was sent before"], ["the costs are too high", "nothing has been changed", "the owners were asked", "the work will end soon"]),
    "de": (["der Bericht", "dieses Blatt", "unser Modell", "die neue Pumpe"], ["zeigt dass", "erklärt nicht warum", "wurde verschickt bevor"], ["die Kosten zu hoch sind", "nichts geändert wurde", "die Eigner gefragt wurden", "die Arbeit bald endet"]),
    "fr": (["le rapport", "cette feuille", "notre modèle", "la nouvelle pompe"], ["montre que", "n'explique pas pourquoi", "a été envoyé avant que"], ["les coûts sont trop élevés", "rien n'a été changé", "les associés ont été consultés", "le travail finit bientôt"]),
    "sv": (["rapporten", "det här bladet", "vår modell", "den nya pumpen"], ["visar att", "förklarar inte varför", "skickades innan"], ["kostnaderna är för höga", "ingenting har ändrats", "ägarna tillfrågades", "arbetet snart är slut"]),
}


def _said(rng, lang):
    return " ".join(rng.choice(x) for x in PARTS[lang]).capitalize() + "."


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    sample = []
    for lang in PARTS:
        for _ in range(60):
            true = lang if rng.random() > 0.1 else rng.choice(list(PARTS))  # a tenth is labelled wrongly
            sample.append((lang, " ".join(_said(rng, true) for _ in range(3))))
    return train(sample)


def test_sentences_and_windows():
    text = 'A1 | 2.5 | #N/A =SUM(A1:A3) The report "Umsatz der Woche" shows that costs\r\n rise by 3 % now. Pumps North Depot Debt 12. ok!\n\n\nEnd of the list here now'
    assert [s for _, s in sentences(text)] == ["the report shows that costs rise by now", "end of the list here now"]
    assert sentences("") == [] and sentences("1 2 3 4 5") == []
    long = "ord " * 100
    assert all(len(w) == 128 for w in windows(long)) and windows(long)[-1].rstrip(b"\0").endswith(b"ord  ") and len(windows("kort")) == 1


def test_held_out_accuracy(net):
    rng = random.Random(77)
    said = [(lang, sentences(_said(rng, lang))[0][1]) for lang in PARTS for _ in range(40)]
    probs = net.sentence_probs([s for _, s in said])
    assert np.mean([LANGS[p.argmax()] == lang for (lang, _), p in zip(said, probs)]) > 0.97
    assert set(SEEDS) == set(LANGS) and np.allclose(probs.sum(1), 1, atol=1e-4)


def test_labels(spark):
    names = ["en", "EN-gb", "Deutsch", " fra ", "pt_BR", "und", "", None, "??", "svenska"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "l string").select(label_code(F.col("l")).alias("c")).collect()]
    assert got == ["en", "en", "de", "fr", "pt", None, None, None, None, "sv"]


def test_wrong_labels(spark, net):
    rng = random.Random(5)
    en, de, fr = (lambda n, k=k: " ".join(_said(rng, k) for _ in range(n)) for k in ("en", "de", "fr"))
    docs = [(1, en(3), "en-GB", "x"), (2, de(3), "en", "x"), (3, fr(2), None, "x"), (4, f"{en(4)}\n{de(2)} {en(3)}", "English", "x"), (5, None, None, "x"), (6, "12 13 14", "und", "x"), (7, "", "", "x"), (2, de(3), "en", "x")]
    df = spark.createDataFrame(docs, DOC)
    got = sorted(tuple(r) for r in wrong_labels(df, net).collect())
    assert got == [(2, 0, "de"), (3, 0, "fr"), (4, 1, "en"), (4, 2, "de"), (4, 3, "en")]
    seg = language_segments(df, net).filter("doc_id = 4 and seg_no = 0").first()
    assert seg.lang == "en" and 0.5 < seg.confidence <= 1
    assert wrong_labels(df.limit(0), net).count() == 0
