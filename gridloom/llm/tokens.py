"""Encoding texts with a public byte-level tokenizer, pre-tokenised without regular expressions.

A batch of texts becomes one array of code points, each mapped to a class. Where a piece starts depends on a small
automaton over the classes; its transition functions compose associatively, so the array is cut into equal lanes,
the lanes' functions are scanned side by side, and lane results are composed. Slices feed a cached pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter everywhere, and the files are only ever read.
VOCABULARIES = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
CACHE_PIECES, LANES, LONG = 400_000, 4096, 48

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE, MARK2, MARK3, END = range(8)
# states: what the piece so far is. START: nothing; LEAD: one space that the next piece takes; TAILn: n letters of a contraction to come
START, IN_L, IN_N, IN_O, LEAD, TAIL1, TAIL2 = range(7)


def _step(kind: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at a code point of this class. SPACE is a blank the next piece takes."""
    if state in (TAIL1, TAIL2):  # only letters follow, as the contraction was looked up beforehand
        return (TAIL1 if state == TAIL2 else START), False
    if kind in (BLANK, END):
        return START, True  # starts of blank runs are corrected by position, see below
    if kind == SPACE:
        return LEAD, True
    if kind in (MARK2, MARK3) and state not in (IN_O, LEAD):
        return (TAIL1 if kind == MARK2 else TAIL2), True
    to = {LETTER: IN_L, NUMBER: IN_N}.get(kind, IN_O)
    return to, state not in (to, LEAD)


NEXT = np.array([[_step(k, s)[0] for s in range(7)] for k in range(8)], np.uint8)
BEGINS = np.array([[_step(k, s)[1] for s in range(7)] for k in range(8)], bool)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, from its Unicode category; white space is the property White_Space."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            table[cp] = LETTER
        elif c == "N":
            table[cp] = NUMBER
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return table


def scan_states(kinds: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The automaton's state before each position, by an associative scan over transition functions."""
    n = len(kinds)
    width = max(1, -(-n // lanes))
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = kinds
    grid = grid.reshape(rows, width).T  # position in the lane first
    whole = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))  # each lane's function, starting from the identity
    for kind in grid:
        whole = NEXT[kind[:, None], whole]
    enter = np.zeros(rows, np.uint8)
    for i in range(1, rows):  # composing the lanes' functions gives the state each lane is entered in
        enter[i] = whole[i - 1, enter[i - 1]]
    out = np.empty((width, rows), np.uint8)
    state = enter
    for i, kind in enumerate(grid):
        out[i] = state
        state = NEXT[kind, state]
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts laid end to end, each followed by one sentinel 0 at ``ends``."""
    kinds = class_table()[points]
    kinds[ends] = END
    n = len(points)
    low = np.where(points < 128, points, 0)
    nxt = lambda k: np.r_[low[k:], np.zeros(min(k, n), low.dtype)][:n]
    mark = points == ord("'")
    one, two = nxt(1), nxt(2)
    kinds[mark & np.isin(one, [ord(c) for c in "sdmt"])] = MARK2
    pairs = [(ord(a), ord(b)) for a, b in ("ll", "ve", "re")]
    kinds[mark & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])] = MARK3
    blank = kinds == BLANK
    solid_next = np.r_[~blank[1:] & (kinds[1:] != END), False]
    kinds[blank & solid_next & (points == 32)] = SPACE
    starts = BEGINS[kinds, scan_states(kinds)]
    # of a run of blanks only the first starts a piece, and the last again if a text goes on behind it
    before = np.r_[False, blank[:-1]]
    starts[blank] = (~before | solid_next)[blank]
    return starts


def slices(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces of all texts, how many each text has, and each piece's byte offset within its text."""
    joined = "\0".join([*texts, ""]) if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    starts = piece_starts(points, ends)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.r_[0, np.cumsum(size)]
    raw = joined.encode("utf-8", "surrogatepass")
    cuts = np.flatnonzero(starts)
    stops = np.r_[cuts[1:], len(points)]
    keep = ~np.isin(cuts, ends)
    b0, b1 = at[cuts].tolist(), at[stops].tolist()
    pieces = [raw[i:j] for i, j, k in zip(b0, b1, keep.tolist()) if k]
    text_of = np.searchsorted(ends, cuts[keep])
    first = np.r_[0, at[ends + 1]][:-1] if len(texts) else np.zeros(0, np.int64)
    return pieces, np.bincount(text_of, minlength=len(texts)), at[cuts[keep]] - first[text_of]


class PairMerger:
    """Ids of a piece of bytes by merging the pair of lowest rank first; pieces met before come from a bounded cache."""

    def __init__(self, folder: str = VOCABULARIES, name: str = TOKENIZER) -> None:
        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def ids(self, piece: bytes) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            whole = self.ranks.get(piece)
            got = (whole,) if whole is not None else self._few(piece) if len(piece) <= LONG else self._many(piece)
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece if len(piece) < 64 else bytes(piece)] = got
        return got

    def _few(self, piece: bytes) -> tuple[int, ...]:
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _many(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over linked parts, n log n for very long pieces."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = left[i]
            if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


@lru_cache(maxsize=4)
def merger(folder: str = VOCABULARIES, name: str = TOKENIZER) -> PairMerger:
    """One merger a Python worker, shared by its tasks."""
    return PairMerger(folder, name)


def encode_texts(texts: Iterable[str | None], folder: str = VOCABULARIES, name: str = TOKENIZER) -> list[list[int]]:
    """Ids of each text; a null or empty text has the empty list."""
    m, texts = merger(folder, name), [t or "" for t in texts]
    out: list[list[int]] = []
    for lo, hi in _groups(texts):
        pieces, counts, _ = slices(texts[lo:hi])
        find, at, ids = m.cache.get, 0, m.ids
        for n in counts.tolist():
            doc: list[int] = []
            for p in pieces[at : at + n]:
                doc.extend(find(p) or ids(p))
            at += n
            out.append(doc)
    return out


def _groups(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a million code points, so arrays stay small whatever the batch."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, folder: str = VOCABULARIES, name: str = TOKENIZER) -> DataFrame:
    """doc_id and ids of every document, in the tokenizer's own ids and without special tokens.

    Null and empty texts have the empty list; strings of special tokens inside a text are ordinary text. Repeated
    rows are encoded each for itself; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": encode_texts(pdf.text, folder, name)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def piece_offsets(docs: DataFrame) -> DataFrame:
    """Of every document its number of pieces, and the byte offset at which each starts, for decoding parts of it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, rows = [t or "" for t in pdf.text], []
            for lo, hi in _groups(texts):
                _, counts, at = slices(texts[lo:hi])
                rows += [x.tolist() for x in np.split(at, np.cumsum(counts)[:-1])]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_pieces": [len(x) for x in rows], "offsets": rows})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_pieces int, offsets array<int>")


def token_counts(docs: DataFrame, folder: str = VOCABULARIES, name: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens, without moving ids out of Python."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_tokens": [len(x) for x in encode_texts(pdf.text, folder, name)]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens int")


def round_trip(docs: DataFrame, folder: str = VOCABULARIES, name: str = TOKENIZER) -> DataFrame:
    """Documents whose decoded ids differ from their text; none is expected."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merger(folder, name)
        for pdf in batches:
            ok = [m.decode(i) == (t or "").encode() for i, t in zip(encode_texts(pdf.text, folder, name), pdf.text)]
            yield pdf.loc[~np.array(ok, bool), ["doc_id"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long").select(F.col("doc_id"))
