"""Cleaning and tokens."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import STOP_WORDS

# Characters blanked before tokens are taken (fixed value); "]" is not one of them.
SPECIAL = r"""['"</&\[+>()\-]"""
BLANKS = " \t\n\x0b\f\r"


def text(c: Column | str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_special(c: Column) -> Column:
    """Special characters become blanks; null stays null."""
    return F.regexp_replace(c, SPECIAL, " ")


def two_step_replace(c: Column) -> Column:
    """Dashes, slashes and brackets become one blank, then quotes and dots vanish."""
    return F.regexp_replace(F.regexp_replace(c, "[-/()]+", " "), "['.]+", "")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+", " ")


def ws_tokens(c: Column) -> Column:
    """Lower-cased pieces between single blanks.

    Empty pieces inside are kept and trailing ones dropped; the empty text has one empty piece,
    a text of blanks has none.
    """
    low = F.lower(c)
    cut = F.rtrim(low, F.lit(BLANKS))
    return (
        F.when(low == "", F.array(F.lit("")))
        .when(cut == "", F.array().cast("array<string>"))
        .otherwise(F.split(cut, r"[ \t\n\x0B\f\r]"))
    )


def words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens not in the list; repeated tokens stay repeated."""
    return F.filter(tokens, lambda t: ~t.isin(stop))


def useful_words(c: Column) -> Column:
    """Word tokens that are not stop words."""
    return without(words(c), STOP_WORDS)


def title_words(c: Column) -> Column:
    """Punctuation deleted, stop words dropped case-sensitively, then lower-cased."""
    bare = F.trim(F.translate(c, string.punctuation, ""), F.lit(BLANKS))
    pieces = F.array_remove(F.split(bare, r"[ \t\n\x0B\f\r]+"), "")
    return F.transform(without(pieces, STOP_WORDS), F.lower)


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = [(chr(n), unicodedata.normalize("NFD", chr(n))) for n in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    marked, plain = _accent_pairs()
    return F.translate(c, marked, plain)


def fold_tokens(c: Column) -> Column:
    """Words of the accent-folded text, case kept, stop words dropped case-sensitively."""
    return without(F.regexp_extract_all(fold_accents(c), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), STOP_WORDS)


def clean_words(c: Column) -> Column:
    """Everything but ASCII letters and digits blanked, lower-cased, stop words dropped."""
    low = F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", " "))
    return without(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), STOP_WORDS)
