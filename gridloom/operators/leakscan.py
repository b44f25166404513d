"""The self-scan of anonymised reports: a model's own strings are looked for in every text that would leave.

Three kinds of strings: ``sub`` (one-word names, found inside words once generic words are blanked out), ``gram``
(labels and texts of two words or eight characters, found as word sequences, long ones by their first twelve words and then as a whole) and ``term`` (words
of three letters that are not generic). All are found by equi-joins on words, grams or leading letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import fold, words
from gridloom.operators.diagnostics import MAX_GRAM, grams

ANCHOR = 4


def _norm(text: Column) -> Column:
    return F.array_join(words(fold(text)), " ")


def _letters(w: Column) -> Column:
    return F.length(F.regexp_replace(w, r"(?U)[^\p{L}]", ""))


def forbidden_strings(sheets: DataFrame, lines: DataFrame, names: DataFrame, generic: list[str]) -> DataFrame:
    """workbook_id, kind, s: the strings of each model that no report may show, without the ``generic`` words."""
    named = sheets.select("workbook_id", F.col("sheet").alias("t"), F.lit(4).alias("least")).unionByName(names.filter(~F.col("name").startswith("_xlnm")).select("workbook_id", F.col("name").alias("t"), F.lit(5).alias("least")))
    named = named.filter(F.length(F.trim("t")) >= F.col("least")).withColumn("n", _norm(F.col("t"))).filter("length(n) >= 4")
    subs = named.select("workbook_id", F.lit("sub").alias("kind"), F.replace("n", F.lit(" "), F.lit("")).alias("s"))
    long = named.filter(F.col("n").contains(" ")).select("workbook_id", F.lit("gram").alias("kind"), F.col("n").alias("s"))
    texts = lines.select("workbook_id", F.explode(F.array("label", "section", "units")).alias("t")).dropna().distinct().unionByName(sheets.select("workbook_id", F.col("sheet").alias("t")))
    pieces = texts.select("workbook_id", F.explode(F.concat(F.array("t"), F.split("t", r"[,;|()\[\]{}'\"`:/\\]+"))).alias("t")).withColumn("n", _norm(F.col("t")))
    phrases = pieces.filter(F.col("n").contains(" ") | (F.length("n") >= 8)).select("workbook_id", F.lit("gram").alias("kind"), F.col("n").alias("s"))
    terms = texts.unionByName(named.select("workbook_id", "t")).select("workbook_id", F.lit("term").alias("kind"), F.explode(words(fold("t"))).alias("s")).filter(_letters(F.col("s")) >= 3)
    every = subs.unionByName(long).unionByName(phrases).unionByName(terms).filter("s <> ''").distinct()
    return every.filter(~F.col("s").isin(generic)) if generic else every


def scan(texts: DataFrame, forbidden: DataFrame, generic: list[str], key: str = "text_id") -> DataFrame:
    """Hits of ``texts`` (workbook_id, key, text) on the strings of the same workbook: workbook_id, key, kind, s."""
    base = texts.select("workbook_id", key, F.col("text")).dropna(subset=["text"]).withColumn("_w", words(fold("text")))
    word = base.select("workbook_id", key, F.explode(F.array_distinct("_w")).alias("s")).join(forbidden.filter("kind = 'term'"), ["workbook_id", "s"])
    phrase = forbidden.filter("kind = 'gram'").withColumn("gram", F.array_join(F.slice(F.split("s", " "), 1, MAX_GRAM), " "))
    sizes = sorted(r[0] for r in phrase.select(F.size(F.split("gram", " "))).distinct().collect())  # twelve at most
    gram = grams(base, ["workbook_id", key], F.col("_w"), sizes or [1]).join(phrase, ["workbook_id", "gram"])
    long = F.size(F.split("s", " ")) > MAX_GRAM
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    sure = gram.filter(long).join(base.select("workbook_id", key, padded(F.array_join("_w", " ")).alias("_t")), ["workbook_id", key]).filter(F.contains("_t", padded(F.col("s")))).drop("_t")
    gram = gram.filter(~long).unionByName(sure)
    rest = F.array_join(F.transform("_w", lambda w: F.when(w.isin(generic), F.lit(" ")).otherwise(w)) if generic else F.col("_w"), " ")
    packed = base.select("workbook_id", key, F.regexp_replace(rest, " +", " ").alias("t"))
    anchors = packed.filter(F.length("t") >= ANCHOR).select("workbook_id", key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - (ANCHOR - 1)), lambda i: F.substring("t", i, F.lit(ANCHOR))))).alias("a"))
    near = anchors.join(forbidden.filter("kind = 'sub'").withColumn("a", F.substring("s", 1, ANCHOR)), ["workbook_id", "a"]).drop("a")
    sub = near.join(packed, ["workbook_id", key]).filter(F.col("t").contains(F.col("s")))
    cols = ["workbook_id", key, "kind", "s"]
    return word.select(*cols).unionByName(gram.select(*cols)).unionByName(sub.select(*cols)).distinct()


def release(texts: DataFrame, hits: DataFrame, known_models: DataFrame, key: str = "text_id") -> DataFrame:
    """Which workbooks' reports may leave: blocked by a hit, by other than ASCII characters, or by an unknown model.

    ``known_models`` are those whose registry could be read; a model that is not among them is blocked.
    """
    bad = hits.groupBy("workbook_id").agg(F.countDistinct(key, "s").alias("n_hits"))
    per = texts.groupBy("workbook_id").agg(F.count_if(F.col("text").rlike(r"[^\x00-\x7f…]")).alias("n_odd"))
    out = per.join(bad, "workbook_id", "left").join(known_models.select("workbook_id").distinct().withColumn("_known", F.lit(True)), "workbook_id", "left")
    reason = F.when(F.col("_known").isNull(), "registry unreadable").when(F.coalesce("n_hits", F.lit(0)) > 0, "hit").when(F.col("n_odd") > 0, "non-ascii")
    return out.select("workbook_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "n_odd", reason.alias("reason"), reason.isNotNull().alias("blocked"))
