"""Scalar text functions as column expressions; only the Unicode fold needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility form without case, for comparing names across scripts and widths."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def words(text: Column) -> Column:
    """Lower-case words of a text, letters and digits of any script; marks part them."""
    t = F.trim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def name_tokens(name: Column) -> Column:
    """Word parts of a sheet name: camel case, capitals and numbers are parted."""
    return F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))


def clean_number(x: Column) -> Column:
    """What JSON can hold: null for a value that is no number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def model_token(content: Column) -> Column:
    """M and the first eight hexadecimal digits of the SHA-256."""
    return F.concat(F.lit("M"), F.substring(F.sha2(content, 256), 1, 8))


def period_label(d: Column, periodicity: Column) -> Column:
    """FY and the year for annual periods, else month and year such as Jun-26."""
    return F.when(periodicity == "annual", F.concat(F.lit("FY"), F.year(d).cast("string"))).otherwise(F.date_format(d, "MMM-yy"))


#: What a message is made of, tried in this order at every place; whatever is left is one character.
_PIECES = (
    r"""(?s)(["'])(?:(?!\1)[^\n])*\1"""  # quoted text
    r"""|(?:[A-Za-z]:)?(?:[\\/][^\s\\/'"]+){2,}[\\/]?"""  # path
    r"|[0-9]+(?:[-/.:,][0-9]+)*(?:[ T][0-9]{1,2}(?::[0-9]{2})+(?:\.[0-9]+)?)?"  # figure, date or time
    r"|R(?:\[-?[0-9]+\]|[0-9]+)?C(?:\[-?[0-9]+\]|[0-9]+)?(?![A-Za-z0-9_])"  # relative reference
    r"|[A-Za-z_][A-Za-z0-9_]*"  # word
    r"|."
)
#: Tokens that stand for a sheet, unknown sheet, name, function or model, the length a message may have.
TOKEN, LONGEST_MESSAGE = r"^(?:S|X|NAME|FN|M)[0-9]+$", 400
DATE = r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?:[ T][0-9:.]+)?$"


def safe_message(text: Column, known: list[str]) -> Column:
    """A message that may leave: it is cut into pieces and each piece is shown, named or blotted out by its kind.

    Quotations lose their content; dates, paths and telling figures (four digits, decimals, thousands) become ``<date>``,
    ``<path>`` and ``#``; words not in ``known`` and what is not ASCII become an ellipsis, several in a row one. Tokens
    such as S3, NAME2 or R5C3 stay.
    """
    hidden, shown = F.lit("…"), [w.lower() for w in known]

    def piece(p: Column) -> Column:
        head, size = F.substring(p, 1, 1), F.length(p)
        mark = F.when(head.isin("'", '"') & (size > 1), F.concat(head, hidden, head))
        mark = mark.when(p.rlike(DATE), F.lit("<date>")).when(p.rlike(r"^[0-9]"), F.when(p.rlike(r"[0-9]{4}|[.,]"), F.lit("#")).otherwise(p))
        mark = mark.when(p.rlike(r"^(?:[A-Za-z]:)?[\\/].") & (size > 2), F.lit("<path>")).when(p.rlike(r"^R.*C") & p.rlike(r"^[RC0-9\[\]-]+$") | p.rlike(TOKEN), p)
        return mark.when(p.rlike(r"^[A-Za-z_]"), F.when(F.lower(p).isin(shown), p).otherwise(hidden)).when(p.rlike(r"[^\x00-\x7f]"), hidden).otherwise(p)

    said = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece), "")
    return F.substring(F.regexp_replace(said, "…(?:[ .]?…)+", "…"), 1, LONGEST_MESSAGE)
