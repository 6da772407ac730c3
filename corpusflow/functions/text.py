"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word is a run of Unicode letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tokens(column: Column | str) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(_c(column)), F.lit(WORD), F.lit(0))


def token_count(column: Column | str) -> Column:
    """Number of words, without building the array."""
    return F.regexp_count(_c(column), F.lit(WORD))


def squeeze(column: Column | str) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return F.btrim(F.regexp_replace(_c(column), r"\s+", " "))


def words(column: Column | str) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(_c(column), r"\s+"), lambda w: w != "")


def token_estimate(column: Column | str) -> Column:
    """One token per four characters, rounded down."""
    return F.floor(F.length(_c(column)) / 4).cast("long")


def any_of(text: Column, phrases: list[str]) -> Column:
    """True if the text contains one of the phrases."""
    test = F.lit(False)
    for phrase in phrases:
        test = test | text.contains(phrase)
    return test


def count_of(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + text.contains(phrase).cast("int")
    return total


def any_match(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True if one of the patterns is found."""
    # U: word characters and boundaries are those of Unicode.
    flag = "(?iU)" if ignore_case else ""
    test = F.lit(False)
    for pattern in patterns:
        test = test | text.rlike(flag + pattern)
    return test


def exploded(df: DataFrame, array: str, out: str) -> DataFrame:
    """One row per array element.

    The outer form keeps Catalyst from adding a "size > 0" filter that would run
    the array's expression a second time, below the exchange.
    """
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())
