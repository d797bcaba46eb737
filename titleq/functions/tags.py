"""Rule tagger for title words: closed classes by list, open classes by ending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import (
    ADJECTIVE_ENDINGS,
    ADJECTIVES,
    ADVERB_ENDINGS,
    CONJUNCTIONS,
    FUNCTION_WORDS,
    NUMBER_WORDS,
    VERB_ENDINGS,
)


def raw_tokens(c: Column) -> Column:
    """Runs of letters and digits and single other signs, case kept, blanks dropped."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def _ends(t: Column, endings: list[str]) -> Column:
    return t.rlike("[a-z]{2}(" + "|".join(endings) + ")$")


def tag(t: Column) -> Column:
    """Tag of one token."""
    # The one-element array binds the lower-cased token, so it is computed once.
    return F.element_at(F.transform(F.array(F.lower(t)), _rule), 1)


def _rule(low: Column) -> Column:
    return (
        F.when(low.rlike("^[0-9][0-9_]*$") | low.isin(NUMBER_WORDS), "NUM")
        .when(low.rlike(r"^[$%+=<>~^&#@|*/]$"), "SYM")
        .when(~low.rlike(r"[\p{L}\p{N}_]"), "PUNCT")
        .when(low.isin(CONJUNCTIONS), "CCONJ")
        .when(low.isin(FUNCTION_WORDS), "FUNC")
        .when(_ends(low, ADVERB_ENDINGS), "ADV")
        .when(low.isin(ADJECTIVES) | _ends(low, ADJECTIVE_ENDINGS), "ADJ")
        .when(_ends(low, VERB_ENDINGS), "VERB")
        .otherwise("NOUN")
    )


def tagged(c: Column) -> Column:
    """array<struct<tag,text>> of a title."""
    return F.transform(raw_tokens(c), lambda t: F.struct(tag(t).alias("tag"), t.alias("text")))
