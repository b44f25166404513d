"""Freely typed labels to the entries of a canonical list, with what names no entry reported.

An automaton over all canonical names and wordings finds mentions inside a label, the longest of overlapping ones
winning. A label that says no more than one mention is that entry; what else a label says makes it another
quantity. Labels without such a mention go to similarities of token sets: of the words as they are written, which
bears misspellings and short forms, then of what the words mean by the general :mod:`~gridloom.llm.lexicon`, which bears
other wordings and languages. No list of labels is kept; further wordings may be given as a parameter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.lexicon import CARRIERS, Lexicon
from gridloom.operators.skew import balanced_join
from gridloom.operators.units import UnitIndex, edit_cost, grams, known_spellings
from gridloom.tables import materialise

#: Words that dress a label and change nothing in what it names.
DRESS = set("total less of which memo note see calc calculated nominal real terms base case in pa p a incl excl thereof davon dont summe gesamt".split())
_HEAD = re.compile(r"^(?:\s*(?:\d+(?:\.\d+)*[.)]?\s+|[a-z]\)\s*|[•*\-–·>]+\s*|(?:total|less|of which|davon|dont)\b\s*:?\s*))+")
_TAIL = re.compile(r"(?:\s*[*:]+|\s*[(\[](?:see note|calc|nominal|real)[)\]]|,?\s*real terms|,?\s*nominal|\s*-\s*base case|\s+p\.\s?a\.?)+\s*$")
_UNIT = [re.compile(p) for p in (r"^(.*?\S)\s*[(\[]([^()\[\]]+(?:\([^()]*\))?)[)\]]$", r"^(.*[^,\s])\s+in\s+(\S.*)$", r"^(.*\S)\s*,\s+(\S.*)$")]
#: Edits allowed per letter of the longer text, the score that is enough, and the share of n-grams a candidate must have.
ALLOWED, ENOUGH, LIKE = 0.25, 0.75, 0.2
#: Shares of a label's and of a wording's meaning that must be met, by how much the best entry must lead; how many cores a task keeps at most in its memory.
ALL_OF, HALF, CLEAR, MOST_KEPT = 0.95, 0.5, 0.05, 200_000
#: So many mapped labels (some 10 MB) may be broadcast.
FEW_LABELS = 200_000


def folded(text: str) -> str:
    """Compatibility form, lower case, without accents; underscores and blanks of any kind become one blank, a 0 inside a word an o."""
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    t = "".join(c for c in t if not unicodedata.combining(c) and c not in "​﻿")
    t = re.sub(r"[\s_]+", " ", t).strip().replace("’", "'")
    return re.sub(r"(?<=[^\W\d_])0(?!\d)|(?<!\d)0(?=[^\W\d_]|/s\b)", "o", t)


def tokens(t: str) -> list[str]:
    return [w for w in re.split(r"[^\w/]+", t.replace("'", " ")) if w]


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a short form of ``word``: its letters stand in it in order, the first one first."""
    letters = short.replace("/", "")
    if not 2 <= len(letters) < len(word) or letters[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in letters)


class Canon:
    """The canonical list: automaton, token sets, an index of character n-grams and what each entry means.

    ``vocab`` rows are (role_id, name, wordings parted by ``|``, description); the description takes part in meaning only.
    ``aliases`` may give further wordings by name. At most one entry is given to a label, 0 where two fit equally well.
    """

    def __init__(self, vocab: list[tuple], aliases: dict[str, str], unit_codes: Iterable[str]) -> None:
        self.units = UnitIndex(known_spellings(unit_codes))
        self.entries: dict[str, tuple[int, list[str]]] = {}
        self.lexicon = Lexicon()
        self.meanings: list[tuple[int, list[frozenset[str]]]] = []
        for role_id, name, words, *what in vocab:
            phrases = [name.replace("_", " "), *(words or "").split("|"), *aliases.get(name, "").split("|")]
            for phrase in phrases:
                ws = tokens(folded(phrase))
                if ws:
                    self.entries.setdefault("".join(ws), (role_id, ws))
            for phrase in [*phrases, *[w for w in what if w]]:
                t = folded(phrase)
                if said := [cs - {"OTHER"} for cs in self.lexicon.said(t, tokens(t)) if cs != {"OTHER"}]:
                    self.meanings.append((role_id, said))
        self.profiles: dict[int, set[str]] = defaultdict(set)
        for role_id, said in self.meanings:
            self.profiles[role_id].update(*said)
        n = Counter(c for p in self.profiles.values() for c in p)
        self.rare = {c: math.log((1 + len(self.profiles)) / k) for c, k in n.items()}
        self.rarest = math.log(1 + len(self.profiles))
        self.weights: dict[frozenset[str], float] = {}
        self.about: dict[str, set[int]] = defaultdict(set)
        for role_id, profile in self.profiles.items():
            for concept in profile:
                self.about[concept].add(role_id)
        self.wordings: dict[int, list[tuple[list[frozenset[str]], float]]] = defaultdict(list)
        for role_id, said in self.meanings:
            self.wordings[role_id].append((said, sum(map(self.weight, said))))
        self.keys = list(self.entries)
        self.machine = ahocorasick.Automaton()
        for k in self.keys:
            self.machine.add_word(k, k)
        if self.keys:
            self.machine.make_automaton()
        self.post: dict[str, list[int]] = defaultdict(list)
        self.sizes = []
        for i, k in enumerate(self.keys):
            own = grams(k)
            self.sizes.append(len(own))
            for g in own:
                self.post[g].append(i)
        self.by_start: dict[tuple, list[tuple[int, list[str]]]] = defaultdict(list)
        for role_id, full in self.entries.values():
            ws = [w for w in full if w not in DRESS] or full
            self.by_start[tuple(sorted(w[0] for w in ws))].append((role_id, ws))
        self.cores: dict[str, tuple[int, str, float]] = {}

    def core(self, label: str) -> str:
        """The label without numbering, dress and unit."""
        t = folded(label)
        for _ in range(4):
            before = t
            t = _TAIL.sub("", _HEAD.sub("", t)).strip()
            for p in _UNIT:
                if (m := p.match(t)) and self.units.find(m[2]):
                    t = m[1].strip()
                    break
            if t == before:
                break
        return t

    def mentions(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Longest non-overlapping mentions that begin and end with words: (first word, behind last, alias)."""
        if not self.keys or not words:
            return []
        starts, ends, at = {}, {}, 0
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w)
            ends[at] = i + 1
        hits = []
        for last, k in self.machine.iter("".join(words)):
            a, b = last + 1 - len(k), last + 1
            if a in starts and b in ends:
                hits.append((starts[a], ends[b], k))
        out: list[tuple[int, int, str]] = []
        for h in sorted(hits, key=lambda h: (-len(h[2]), h[0])):
            if all(h[1] <= o[0] or h[0] >= o[1] for o in out):
                out.append(h)
        return sorted(out)

    def find(self, label: str | None) -> tuple[int, str, float]:
        """(role id or 0, how it was found, score) of a label; labels with the same core are looked at once."""
        core = self.core(label or "")
        if core not in self.cores:
            if len(self.cores) > MOST_KEPT:
                self.cores.clear()
            self.cores[core] = self.find_core(core)
        return self.cores[core]

    def find_core(self, core: str) -> tuple[int, str, float]:
        words = tokens(core)
        if not words:
            return 0, "none", 0.0
        found = self.mentions(words)
        if found:
            covered = {i for a, b, _ in found for i in range(a, b)}
            roles = {self.entries[k][0] for _, _, k in found}
            rest = [w for i, w in enumerate(words) if i not in covered and w not in DRESS]
            if len(roles) == 1 and not rest:
                return roles.pop(), "mention", 1.0
        short = self.shortened([w for w in words if w not in DRESS])
        if short:
            return short, "short", 1.0
        if all(map(self.lexicon.spelt, {*words})):  # no misspelling to look for
            meaning = self.meant(core, words)
            if meaning or len({*words}) == 1:
                return meaning or (0, "none", 0.0)
        got = self.similar(words)
        return got if got[0] else self.meant(core, words) or got

    def weight(self, concepts: frozenset[str]) -> float:
        """What a word weighs: the more, the fewer entries its rarest concept belongs to."""
        if concepts not in self.weights:
            self.weights[concepts] = max(self.rare.get(c, self.rarest) for c in concepts)
        return self.weights[concepts]

    def shortened(self, words: list[str]) -> int:
        """The one entry whose words the label gives, some as short forms; 0 if there is none or more than one."""
        roles = set()
        for role_id, ws in self.by_start.get(tuple(sorted(w[0] for w in words)), ()):
            left = list(ws)
            for w in words:
                at = next((x for x in left if x == w), None) or (next((x for x in left if abbreviates(w, x)), None) if w not in self.lexicon.exact else None)
                if at is None:
                    break
                left.remove(at)
            else:
                roles.add(role_id)
        return roles.pop() if len(roles) == 1 else 0

    def meant(self, core: str, words: list[str]) -> tuple[int, str, float] | None:
        """By what the words mean: every word must belong to what an entry is about, and say at least half of one of its wordings.

        Words weigh by how few entries they belong to. The entry of which clearly most is said wins.
        """
        said = self.lexicon.said(core, [w for w in words if w not in DRESS or w in self.lexicon.joining])
        if not said:
            return None
        roles = [set().union(*(self.about[c] for c in cs if c in self.about)) for cs in said]
        if not all(r or cs & CARRIERS for r, cs in zip(roles, said)):  # a word that belongs to no entry
            return None
        every = set().union(*said)
        if len({*words}) == len({*said}) == 1 and len(roles[0]) > 2:  # a single word that many entries share names none of them
            return None
        weight = self.weight
        fits = set()
        for role_id in set().union(*roles):
            met = sum(weight(cs) for cs, r in zip(said, roles) if role_id in r)
            missed = sum(weight(cs) for cs, r in zip(said, roles) if role_id not in r and not cs & CARRIERS)
            if met >= ALL_OF * (met + missed):
                fits.add(role_id)
        best: dict[int, float] = {}
        for role_id in fits:
            for wording, whole in self.wordings[role_id]:
                part = sum(weight(cs & every) for cs in wording if cs & every) / whole
                best[role_id] = max(best.get(role_id, 0.0), part)
        top = sorted(best.items(), key=lambda x: -x[1])[:2]
        if not top or top[0][1] < HALF or len(top) > 1 and top[1][1] > top[0][1] - CLEAR:
            return None
        return top[0][0], "meaning", top[0][1]

    def similar(self, words: list[str]) -> tuple[int, str, float]:
        said = [w for w in words if w not in DRESS] or words
        joined = "".join(said)
        own = set().union(grams(joined), *map(grams, said))
        shared: dict[int, int] = defaultdict(int)
        for g in own:
            for i in self.post.get(g, ()):
                shared[i] += 1
        best = (0.0, 0)
        for i, n in shared.items():
            if n >= LIKE * self.sizes[i]:
                role, ws = self.entries[self.keys[i]]
                best = max(best, (self.score(said, joined, ws, self.keys[i], max(ENOUGH, best[0])), -role))
        return (-best[1], "similar", best[0]) if best[0] >= ENOUGH else (0, "none", best[0])

    @staticmethod
    def score(said: list[str], joined: str, ws: list[str], key: str, need: float) -> float:
        """The better of the likeness of the joined letters and that of the token sets, words weighing by length.

        Scores that cannot reach ``need`` are not computed to the end.
        """
        size = max(len(joined), len(key))
        most = max(1.0, ALLOWED * size)
        whole = 0.0
        if abs(len(joined) - len(key)) <= most:
            d = edit_cost(joined, key, most)
            whole = 1 - ALLOWED * d / most if d <= most else 0.0
        left, common, room = list(said), 0.0, sum(map(len, said)) + sum(map(len, ws))
        if sum(map(len, ws)) * (1 + 1 / 0.6) < need * room:  # words that agree are at most that much longer
            return whole
        missing = 0
        for w in sorted(ws, key=len, reverse=True):
            s, x = 0.0, ""
            for y in left:
                n = max(len(w), len(y))
                if w == y:
                    s, x = 1.0, y
                    break
                if abs(len(w) - len(y)) <= 0.4 * n and len(set(w) & set(y)) >= 0.5 * min(len(set(w)), len(set(y))):
                    t = 1 - edit_cost(w, y, 0.4 * n) / n
                    if t > s:
                        s, x = t, y
            if s >= 0.6:
                left.remove(x)
                common += s * (len(w) + len(x))
            else:
                missing += len(w)
                if (room - missing) / room < need:
                    return whole
        # a word of the label that stands for none of the entry makes it another quantity
        return max(whole, common / room if sum(map(len, left)) < 4 else 0.0)


def map_labels(labels: DataFrame, vocab: DataFrame, unit_refs: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Distinct ``label`` values with role_id (0 for none), how and score; null and blank labels are left out.

    ``vocab`` (role_id, role_name, vocab, and what where there is such a column) is the fixed canonical list and comes to
    the driver whole, as do the unit codes. Labels are looked at once each, however many rows bear them.
    """
    cols = [c for c in ("role_id", "role_name", "vocab", "what") if c in vocab.columns]
    canon = [tuple(r) for r in vocab.select(*cols).dropna(subset=["role_id", "role_name"]).orderBy("role_id").collect()]
    codes = sorted(r[0] for r in unit_refs.select("unit_code").dropna().distinct().collect())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Canon(canon, aliases or {}, codes)
        for pdf in batches:
            found = [machine.find(x) for x in pdf.label]
            yield pd.DataFrame({"label": pdf.label, "role_id": [f[0] for f in found], "how": [f[1] for f in found], "score": [f[2] for f in found]})

    tasks = labels.sparkSession.sparkContext.defaultParallelism  # small in bytes, long in work: not left to coalescing
    one = labels.select("label").filter(F.col("label").rlike(r"[^\s\p{Z}]")).distinct().repartition(tasks, "label")
    return one.mapInPandas(run, "label string, role_id int, how string, score double")


def map_lines(lines: DataFrame, vocab: DataFrame, unit_refs: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """workbook_id, sheet, row, role_id of every line whose label is neither null nor blank; distinct rows.

    Distinct labels are mapped first and joined back: broadcast where they were counted to be few, else by the skew
    operator, which cuts a label that a third of the rows bear into shards. Of copies of a line that differ each gives
    its row.
    """
    rows = lines.select("workbook_id", "sheet", "row", "label").filter(F.col("label").rlike(r"[^\s\p{Z}]")).distinct()
    mapped = materialise(map_labels(lines, vocab, unit_refs, aliases).select("label", "role_id"))
    if mapped.count() <= FEW_LABELS:
        out = rows.join(F.broadcast(mapped), "label")
    else:
        out = balanced_join(rows, mapped, ["label"], ["workbook_id", "sheet", "row"])
    return out.select("workbook_id", "sheet", "row", "role_id").distinct()
