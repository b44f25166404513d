"""Anonymised diagnostics: buckets, reason codes, scrubbing, frequencies and the leak scan with its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size classes by number of formulas (fixed values).
SMALL, MEDIUM = 5_000, 100_000
MAX_GRAM = 12


def size_class(n: Column) -> Column:
    return F.when(n < SMALL, "small").when(n < MEDIUM, "medium").otherwise("large")


def residual_bucket(residual: Column, scale: Column) -> Column:
    """The largest residual beside the largest value it is made of, as a bucket; null where there is no residual."""
    rel = F.abs(residual) / scale
    out = F.when(residual.isNull(), None).when(residual == 0, "0").when(scale.isNull() | (scale == 0), "scale_zero")
    for most, name in ((1e-9, "<1e-9"), (1e-6, "<1e-6"), (1e-3, "<1e-3"), (1e-1, "<1e-1")):
        out = out.when(rel < most, name)
    return out.otherwise(">=1e-1")


#: Reason codes with the wordings that give them, in order (fixed values).
REASONS = [
    ("periodicity", "periodicity differs"), ("plug", "plug"), ("rejected_by_check", "binding rejected"), ("capped", "capped|stopped after"),
    ("no_overlap", "no period with a number"), ("no_numbers", "zero|no numbers"), ("derived", "derived"), ("structure_mismatch", "not a sum|not a link"),
    ("no_candidate", "not found|not among|too few|^no |: no "),
]


def reason_codes(why: Column) -> Column:
    """The sorted distinct codes of reasons parted by "; "; what no wording fits is ``other``."""
    def code(x: Column) -> Column:
        out = F.when(F.lit(False), "other")
        for name, pattern in REASONS:
            out = out.when(F.lower(x).rlike(pattern), name)
        return out.otherwise("other")

    return F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(why, F.lit("")), "; "), code)))


def scrub_numbers(text: Column) -> Column:
    """Figures of three digits or more become ``#``."""
    return F.regexp_replace(text, r"[0-9]{3,}", "#")


def scrub_dates(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", "<date>")


def scrub_paths(text: Column) -> Column:
    """Drive, share and rooted paths become ``<path>``."""
    return F.regexp_replace(text, r"[A-Za-z]:\\[^\s]+|\\\\[^\s]+|/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+", "<path>")


def csv_guard(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(text.rlike(r"^ *[=+\-@\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def frequency(df: DataFrame, text: str, pattern: str, item: str = "item") -> DataFrame:
    """How often each match of ``pattern`` occurs, and in how many texts."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias(item), F.monotonically_increasing_id().alias("_r"))
    return found.groupBy(item).agg(F.count(F.lit(1)).alias("n_uses"), F.countDistinct("_r").alias("n_texts"))


def grams(df: DataFrame, keys: list[str], words: Column, sizes: list[int]) -> DataFrame:
    """Distinct word n-grams of the given sizes: keys, gram."""
    w = df.select(*keys, words.alias("_w"))

    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return F.when(F.size("_w") >= n, found).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in sizes]
    return w.select(*keys, F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("gram"))


#: Up to so many different first words the positions of candidates are found by a set in the expression itself.
FIRST_WORDS = 5_000


def leak_hits(df: DataFrame, keys: list[str], words: Column, forbidden: DataFrame) -> DataFrame:
    """Forbidden phrases (column ``phrase``, lower case) that occur in each text as whole words: keys, phrase.

    Only positions whose word begins a phrase are looked at, and only grams as long as some phrase are joined; phrases
    of more than 12 words are looked for by their first 12 and then held against the text as a whole. A list with very
    many first words is joined gram by gram, with the same result.
    """
    phrases = forbidden.select(F.array_join(F.slice(F.split("phrase", " "), 1, MAX_GRAM), " ").alias("gram"), "phrase").filter("gram <> ''").distinct()
    long = F.size(F.split("phrase", " ")) > MAX_GRAM
    sizes = sorted(r[0] for r in phrases.select(F.size(F.split("gram", " "))).distinct().collect())
    if not sizes:
        return df.select(*keys, F.lit(None).cast("string").alias("phrase")).limit(0)
    first = phrases.select(F.split_part("gram", F.lit(" "), F.lit(1)).alias("w")).distinct()
    if first.count() > FIRST_WORDS:
        found = grams(df, keys, words, sizes)
    else:
        begins = sorted(r[0] for r in first.collect())
        w = df.select(*keys, words.alias("_w"))
        at = F.filter(F.transform("_w", lambda x, i: F.when(x.isin(begins), i + 1)), lambda p: p.isNotNull())

        def here(p: Column) -> Column:
            return F.array(*[F.when(p + (n - 1) <= F.size("_w"), F.array_join(F.slice("_w", p, F.lit(n)), " ")) for n in sizes])

        found = w.select(*keys, F.explode(F.array_compact(F.array_distinct(F.flatten(F.transform(at, here))))).alias("gram"))
    hits = found.join(phrases, "gram").select(*keys, "phrase").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    whole = df.select(*keys, padded(F.array_join(words, " ")).alias("_t"))
    sure = hits.filter(long).join(whole, keys).filter(F.contains("_t", padded(F.col("phrase")))).select(*keys, "phrase")
    return hits.filter(~long).unionByName(sure).distinct()


def gate(df: DataFrame, keys: list[str], text: str, hits: DataFrame) -> DataFrame:
    """Texts with the reason they may not leave: a hit, other than ASCII characters, or no text at all (fails closed)."""
    bad = hits.select(*keys).distinct().withColumn("_hit", F.lit(True))
    reason = F.when(F.col(text).isNull(), "unreadable").when(F.col("_hit"), "hit").when(F.col(text).rlike(r"[^\x00-\x7f]"), "non-ascii")
    return df.join(bad, keys, "left").select(*keys, reason.alias("reason")).withColumn("blocked", F.col("reason").isNotNull())
