"""Languages of texts and of the stretches of mixed ones, by a byte convolutional network.

Filters of several widths run over windows of bytes, the maximum of each over the window feeds a softmax. The
network is trained here, in numpy, on a bounded sample of labelled texts; applied, it sees whole sentences only,
without quotations, figures, formulas and other things that say nothing about the language.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.tables import path_exists, shared_dir, trimmed

LANGS = ["da", "de", "en", "es", "fr", "it", "nl", "pl", "pt", "sv"]
#: How labels name the languages: two- and three-letter codes, English and own names; regions are cut off before.
NAMES = {
    "da": "da dan danish dansk dänisch danois", "de": "de deu ger german deutsch allemand alemán tedesco",
    "en": "en eng english englisch anglais inglés inglese", "es": "es spa spanish español espanol castellano spanisch espagnol",
    "fr": "fr fra fre french français francais französisch", "it": "it ita italian italiano italienisch italien",
    "nl": "nl nld dut dutch nederlands niederländisch vlaams flemish", "pl": "pl pol polish polski polnisch polonais",
    "pt": "pt por portuguese português portugues portugiesisch portugais", "sv": "sv swe swedish svenska schwedisch suédois",
}
#: A few sentences a language, so that a model exists where hardly any text is labelled.
SEEDS = {
    "da": "Vi ved ikke endnu, hvornår rapporten bliver færdig, men den skal sendes inden ugen er omme. Det er ikke muligt at se hvad der blev ændret, og hvorfor tallene er større end sidste år.",
    "de": "Wir wissen noch nicht, wann der Bericht fertig wird, aber er muss vor Ende der Woche verschickt werden. Es ist nicht zu sehen, was geändert wurde und warum die Zahlen größer sind als im letzten Jahr.",
    "en": "We do not know yet when the report will be ready, but it has to be sent before the end of the week. It is not possible to see what was changed and why the numbers are larger than those of last year.",
    "es": "Todavía no sabemos cuándo estará listo el informe, pero hay que enviarlo antes del final de la semana. No se puede ver qué se ha cambiado ni por qué los números son mayores que los del año pasado.",
    "fr": "Nous ne savons pas encore quand le rapport sera prêt, mais il doit être envoyé avant la fin de la semaine. Il n'est pas possible de voir ce qui a été changé et pourquoi les chiffres sont plus grands que ceux de l'année dernière.",
    "it": "Non sappiamo ancora quando sarà pronta la relazione, ma deve essere spedita prima della fine della settimana. Non è possibile vedere che cosa è stato cambiato e perché i numeri sono più grandi di quelli dello scorso anno.",
    "nl": "Wij weten nog niet wanneer het verslag klaar is, maar het moet voor het einde van de week worden verstuurd. Het is niet te zien wat er is veranderd en waarom de getallen groter zijn dan die van vorig jaar.",
    "pl": "Nie wiemy jeszcze, kiedy raport będzie gotowy, ale trzeba go wysłać przed końcem tygodnia. Nie widać, co zostało zmienione i dlaczego liczby są większe niż w zeszłym roku.",
    "pt": "Ainda não sabemos quando o relatório ficará pronto, mas tem de ser enviado antes do fim da semana. Não é possível ver o que foi alterado nem por que os números são maiores do que os do ano passado.",
    "sv": "Vi vet ännu inte när rapporten blir klar, men den måste skickas före veckans slut. Det går inte att se vad som har ändrats och varför siffrorna är större än förra årets.",
}
#: Bound of the labelled sample: so many texts a language, none longer than so many characters.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WINDOWS = 250, 6_000, 1_500
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 32
WORDS, LETTERS, SURE = 4, 14, 0.85

_BREAK = re.compile("(?<=[.!?])[\"'”’»)\\]]*\\s+|\\s*\n\\s*\n\\s*|\\s+/\\s+")
_LINE_END = re.compile("\r\n?|[\x0b\x0c\x85" + chr(0x2028) + chr(0x2029) + "]")
_QUOTED = re.compile("\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|„[^“”\n]{1,120}[“”]|«[^»\n]{1,120}»|‹[^›\n]{1,120}›")
_WORD = re.compile(r"(?:^|(?<=\s))[(]?([^\W\d_]+(?:['’-][^\W\d_]+)*)[)]?[,;:.!?…]*(?=\s|$)")


def label_code(lang: Column) -> Column:
    """The two-letter code a label names; null if it is missing or names none of the languages."""
    word = F.regexp_extract(F.lower(trimmed(lang)), r"^(\p{L}+)", 1)
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)]
    return F.element_at(F.create_map(*pairs), word) if len(pairs) else F.lit(None)


def sentences(text: str) -> list[tuple[int, str]]:
    """(characters, words in lower case) of each sentence of a text.

    Quotations and words with figures or marks in them are left out first. What then has too few words, or none
    but names (words that begin with a capital among others that do not), is no sentence. A single line end is a
    blank, an empty line ends a sentence.
    """
    out = []
    for part in _BREAK.split(_QUOTED.sub(" ", _LINE_END.sub("\n", unicodedata.normalize("NFC", text)))):
        words = _WORD.findall(part) if part else []
        if len(words) >= WORDS:
            said = " ".join(words)
            if len(said) >= LETTERS and (_small(words) >= 3 or said.isupper() and len(words) >= 6):
                out.append((len(said), said.lower()))
    return out


def _small(words: list[str], enough: int = 3) -> int:
    """How many words begin with a small letter, counted no further than ``enough``."""
    n = 0
    for w in words:
        n += w[0].islower()
        if n == enough:
            break
    return n


def plain_letters(said: str) -> str:
    """Without accents, as typed on a keyboard that has none."""
    return "".join(c for c in unicodedata.normalize("NFD", said) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")


def windows(said: str) -> list[bytes]:
    """Fixed-length windows over the bytes of a sentence, the last one ending with it; a short one is padded."""
    raw = b" " + said.encode() + b" "
    cuts = [*range(0, max(1, len(raw) - WINDOW + 1), WINDOW)]
    if len(raw) > WINDOW and cuts[-1] + WINDOW < len(raw):
        cuts.append(len(raw) - WINDOW)
    return [raw[i : i + WINDOW].ljust(WINDOW, b"\0") for i in cuts]


class ByteNet:
    """Filters over one-hot bytes (a gather and add), maximum over the window, softmax."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {f"w{w}": rng.normal(0, 0.25 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self._pairs: dict[str, np.ndarray] | None = None
        self.p |= {"out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(LANGS))).astype(np.float32), "bias": np.zeros(len(LANGS), np.float32)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        feats, back = [], []
        for w in WIDTHS:
            k, n = self.p[f"w{w}"], x.shape[1] - w + 1
            z = k[0][x[:, :n]]
            for j in range(1, w):
                z += k[j][x[:, j : n + j]]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"]
            feats.append(np.maximum(top, 0))
            back.append((w, at, top > 0))
        h = np.concatenate(feats, 1)
        s = h @ self.p["out"] + self.p["bias"]
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), [h, back]

    def pair_tables(self) -> dict[str, np.ndarray]:
        """What two neighbouring bytes add to each filter, so that a filter of four bytes is two gathers."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        w2, w3, w4 = (self.p[f"w{w}"] for w in (2, 3, 4))
        return {"w2": two(*w2), "w3": two(*w3[:2]), "w3c": w3[2], "w4": two(*w4[:2]), "w4c": two(*w4[2:])}

    def predict(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """Probabilities of each window: the numbers of :meth:`forward` without what only learning needs.

        Windows are taken by length, and beyond four bytes of padding there is nothing new for a maximum to see.
        """
        if not len(x):
            return np.zeros((0, len(LANGS)), np.float32)
        if self._pairs is None:
            self._pairs = self.pair_tables()
        t, out = self._pairs, np.empty((len(x), len(LANGS)), np.float32)
        size = np.minimum(x.shape[1] - (x[:, ::-1] != 0).argmax(1) + 4, x.shape[1])
        order = np.argsort(size, kind="stable")
        take = lambda k, i: np.take(t[k], i, axis=0, mode="clip")
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            b = x[at, : size[at[-1]]].T.astype(np.intp)  # places first: the maximum then runs over whole rows of memory
            pair = b[:-1] * 256 + b[1:]
            z3, z4 = take("w3", pair[:-1]), take("w4", pair[:-2])
            z3 += take("w3c", b[2:])
            z4 += take("w4c", pair[2:])
            tops = [z.max(0) + self.p[f"b{w}"] for w, z in ((2, take("w2", pair)), (3, z3), (4, z4))]
            s = np.maximum(np.concatenate(tops, 1), 0) @ self.p["out"] + self.p["bias"]
            e = np.exp(s - s.max(1, keepdims=True))
            out[at] = e / e.sum(1, keepdims=True)
        return out

    def dumps(self) -> bytes:
        """The weights as bytes, without pickling."""
        buf = io.BytesIO()
        np.savez(buf, **self.p)
        return buf.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> ByteNet:
        net = cls()
        with np.load(io.BytesIO(raw)) as f:
            net.p = {k: f[k] for k in f.files}
        return net

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 4e-3, batch: int = 64, seed: int = 11) -> None:
        self._pairs = None
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                b = order[i : i + batch]
                p, (h, back) = self.forward(x[b])
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                g = {"out": h.T @ p, "bias": p.sum(0)}
                dh = p @ self.p["out"].T
                for n, (w, at, live) in enumerate(back):
                    d = dh[:, n * FILTERS : (n + 1) * FILTERS] * live
                    gw = np.zeros_like(self.p[f"w{w}"])
                    rows, cols = np.nonzero(d)
                    for j in range(w):  # only the byte under each filter's maximum learns
                        np.add.at(gw[j], (x[b][rows, at[rows, cols] + j], cols), d[rows, cols])
                    g |= {f"w{w}": gw, f"b{w}": d.sum(0)}
                t += 1
                for k, a in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.005 * (g[k] ** 2 - v[k])
                    a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.995**t)) + 1e-7)

    def sentence_probs(self, said: list[str]) -> np.ndarray:
        """Mean of log probabilities over a sentence's windows, as probabilities again."""
        parts = [windows(s) for s in said]
        x = np.frombuffer(b"".join(w for p in parts for w in p), np.uint8).reshape(-1, WINDOW)
        logs = np.log(self.predict(x) + 1e-9)
        sums = np.add.reduceat(logs, np.cumsum([0, *map(len, parts)])[:-1]) / np.array([len(p) for p in parts])[:, None]
        e = np.exp(sums - sums.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_TEXTS) -> DataFrame:
    """At most ``per_lang`` labelled texts a language, chosen by a hash of doc_id; ranks are limited before the shuffle."""
    one = docs.select("doc_id", "text", label_code(F.col("lang")).alias("code")).filter((F.length("text") <= SAMPLE_CHARS) & F.col("code").isNotNull() & (F.length("text") > 40))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= per_lang).orderBy("code", "rank").select("code", "text")


def train(sample: Iterable[tuple[str, str]], epochs: int = 4) -> ByteNet:
    """A network fitted to (code, text) pairs, some of which are labelled wrongly or mixed.

    A fit on sentences as labelled tells which it takes for another language (wrong labels spread over all
    languages, so the right one stays the likeliest); those, and all sentences of texts it takes for another language
    than labelled, are left out of the next fit, twice. Seeds are part of both. Deterministic for the same sample in the same order.
    """
    said: list[str] = []
    gold: list[int] = []
    of: list[int] = []
    for n, (code, text) in enumerate([*[(c, t) for c, t in SEEDS.items() for _ in range(4)], *sample]):
        for _, s in sentences(text):
            of.append(n)
            said.append(s)
            gold.append(LANGS.index(code))
    y0 = np.array(gold)
    seeds = sum(len(sentences(t)) for t in SEEDS.values()) * 4

    def data(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, ys, per = [], [], np.zeros(len(LANGS), int)
        for i in np.random.default_rng(5).permutation(keep).tolist():
            for w in [*windows(said[i]), *(windows(plain_letters(said[i])) if i % 3 == 0 else [])]:
                if per[y0[i]] < SAMPLE_WINDOWS or i < seeds:
                    xs.append(w)
                    ys.append(y0[i])
                    per[y0[i]] += 1
        return np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WINDOW), np.array(ys)

    keep, doc = np.arange(len(said)), np.array(of)
    seeded = keep < seeds
    for n in (2, 3):
        net = ByteNet()
        net.fit(*data(keep), epochs=n)
        probs = net.sentence_probs(said)
        votes = np.zeros((doc.max() + 1, len(LANGS)))
        np.add.at(votes, doc, probs)
        agree = (probs.argmax(1) == y0) & (votes.argmax(1)[doc] == y0)
        keep = np.flatnonzero(agree | seeded)
    net = ByteNet(seed=8)
    net.fit(*data(keep), epochs=epochs)
    return net


def fit_on(docs: DataFrame, per_lang: int = SAMPLE_TEXTS) -> ByteNet:
    """Train on the bounded labelled sample of ``docs``; the sample alone comes to the driver.

    The weights are kept in the shared folder under a digest of the sample, so queries of a session over the same texts
    train once.
    """
    spark = docs.sparkSession
    sample = [(r.code, r.text) for r in labelled_sample(docs, per_lang).toLocalIterator()]
    digest = hashlib.sha256(repr((WINDOW, WIDTHS, FILTERS, SAMPLE_WINDOWS, sorted(SEEDS.items()), sample)).encode()).hexdigest()[:32]
    at = f"{shared_dir(spark).rstrip('/')}/gridloom-net-{digest}"
    if path_exists(spark, f"{at}/_SUCCESS"):
        return ByteNet.loads(bytes(spark.read.parquet(at).first()[0]))
    net = train(sample)
    spark.createDataFrame([(bytearray(net.dumps()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(at)
    return net


def _settle(langs: list[int], probs: np.ndarray) -> list[int]:
    """A sentence the network is unsure of takes the language of a neighbour if that is its second guess."""
    out = list(langs)
    for i, p in enumerate(probs):
        if p[langs[i]] < SURE:
            near = [langs[j] for j in (i - 1, i + 1) if 0 <= j < len(langs) and probs[j][langs[j]] >= SURE]
            good = [k for k in near if p[k] >= 0.02]
            if good:
                out[i] = max(good, key=lambda k: p[k])
    return out


SEGMENTS = "doc_id long, label string, seg_no int, lang string, confidence double, n_chars int"


def language_segments(docs: DataFrame, net: ByteNet) -> DataFrame:
    """Of each text with sentences its main language (seg_no 0) and, if it mixes languages, each stretch in order.

    The main language is that of most characters, ties going to the one met first. ``label`` is the code the
    row's label names, null if none. Confidence is the mean probability over the sentences, weighted by length.
    Texts without sentences (null, blank, figures only) give nothing; repeated rows give repeated results.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        for pdf in batches:
            parts = [sentences(t) if t else [] for t in pdf.text]
            new = sorted({s for p in parts for _, s in p} - known.keys())
            if len(known) > 200_000:
                known.clear()
                new = sorted({s for p in parts for _, s in p})
            for i in range(0, len(new), 4096):
                known.update(zip(new[i : i + 4096], model.value.sentence_probs(new[i : i + 4096])))
            rows = []
            for doc, label, part in zip(pdf.doc_id, pdf.label, parts):
                if not part:
                    continue
                probs = np.stack([known[s] for _, s in part])
                langs = _settle(probs.argmax(1).tolist(), probs)
                size = np.array([n for n, _ in part], float)
                sure = probs[np.arange(len(part)), langs]
                chars = {k: size[np.array(langs) == k].sum() for k in dict.fromkeys(langs)}
                main = max(chars, key=chars.get)
                of = np.array(langs) == main
                rows.append((doc, label, 0, LANGS[main], float((sure * size)[of].sum() / size[of].sum()), int(size[of].sum())))
                if len(chars) > 1:
                    cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                        rows.append((doc, label, n, LANGS[langs[a]], float((sure[a:b] * size[a:b]).sum() / size[a:b].sum()), int(size[a:b].sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "lang", "confidence", "n_chars"])

    return docs.select("doc_id", "text", label_code(F.col("lang")).alias("label")).mapInPandas(run, SEGMENTS)


def wrong_labels(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """doc_id, seg_no, lang: texts whose label is missing or names another language, and all stretches of mixed texts."""
    found = language_segments(docs, net or fit_on(docs))
    case = (F.col("seg_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.filter(case).select("doc_id", "seg_no", "lang").distinct()
