"""Porter and Snowball English stemming as column expressions.

Every step looks for the longest of its endings, splits it off and rewrites it when the remaining
part qualifies. The result is one expression per word, so arrays of tokens are stemmed in place:
no dictionary join, no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Body = Callable[[Column], Column]
Rule = Callable[[Column, Column], Column]

# ---- endings of the published algorithms (fixed values) ----------------------------------------

PORTER_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
PORTER_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
PORTER_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

SNOWBALL_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
SNOWBALL_KEPT = [
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
]
SNOWBALL_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
SNOWBALL_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
SNOWBALL_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]

# ---- shapes of a word: C and V runs, where y after a consonant counts as a vowel ----------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_POSITIVE = f"^({_C})?{_V}{_C}"
MEASURE_ONE = f"^({_C})?{_V}{_C}({_V})?$"
MEASURE_ABOVE_ONE = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
CVC = f"^{_C}[aeiouy][^aeiouwxy]$"

SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _let(value: Column, body: Body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _less(w: Column, n: Column | int = 1) -> Column:
    return F.left(w, F.length(w) - n)


def _split(w: Column, endings: list[str], body: Rule) -> Column:
    """``body(stem, ending)`` for the longest ending of ``w``; ``w`` itself if it has none."""
    longest = "|".join(sorted(endings, key=len, reverse=True))
    return F.when(
        w.rlike(f"({longest})$"),
        _let(
            F.regexp_extract(w, f"({longest})$", 1),
            lambda end: _let(_less(w, F.length(end)), lambda stem: body(stem, end)),
        ),
    ).otherwise(w)


def _rewrite(w: Column, endings: dict[str, str], rule: Rule) -> Column:
    """Rewrite the longest ending if ``rule(stem, ending)`` holds."""
    table = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])
    return _split(
        w,
        list(endings),
        lambda stem, end: F.when(rule(stem, end), F.concat(stem, F.element_at(table, end))).otherwise(
            F.concat(stem, end)
        ),
    )


def _chain(w: Column, *steps: Body) -> Column:
    for step in steps:
        w = _let(w, step)
    return w


def _porter_past(w: Column) -> Column:
    """The step for -eed, -ed and -ing."""

    def repaired(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike("(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"), _less(stem))
            .when(stem.rlike(MEASURE_ONE) & stem.rlike(CVC), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    return _split(
        w,
        ["eed", "ed", "ing"],
        lambda stem, end: F.when(
            end == "eed",
            F.concat(stem, F.when(stem.rlike(MEASURE_POSITIVE), "ee").otherwise("eed")),
        )
        .when(stem.rlike(HAS_VOWEL), repaired(stem))
        .otherwise(w),
    )


def porter(word: Column) -> Column:
    """Stem of a lower-case word by the Porter algorithm."""
    stem = _chain(
        word,
        lambda w: _rewrite(w, PORTER_1A, lambda s, e: F.lit(True)),
        _porter_past,
        lambda w: _rewrite(w, {"y": "i"}, lambda s, e: s.rlike(HAS_VOWEL)),
        lambda w: _rewrite(w, PORTER_2, lambda s, e: s.rlike(MEASURE_POSITIVE)),
        lambda w: _rewrite(w, PORTER_3, lambda s, e: s.rlike(MEASURE_POSITIVE)),
        lambda w: _rewrite(
            w,
            dict.fromkeys(PORTER_4, ""),
            lambda s, e: s.rlike(MEASURE_ABOVE_ONE) & ((e != "ion") | s.rlike("[st]$")),
        ),
        lambda w: _rewrite(
            w,
            {"e": ""},
            lambda s, e: s.rlike(MEASURE_ABOVE_ONE) | (s.rlike(MEASURE_ONE) & ~s.rlike(CVC)),
        ),
        lambda w: F.when(w.rlike("ll$") & w.rlike(MEASURE_ABOVE_ONE), _less(w)).otherwise(w),
    )
    return F.when(F.length(word) <= 2, word).otherwise(stem)


def _snowball_plural(w: Column) -> Column:
    """The step for -sses, -ied, -ies and -s."""
    return _split(
        w,
        ["sses", "ied", "ies", "us", "ss", "s"],
        lambda stem, end: F.when(end == "sses", F.concat(stem, F.lit("ss")))
        .when(
            end.isin("ied", "ies"),
            F.concat(stem, F.when(F.length(stem) > 1, "i").otherwise("ie")),
        )
        .when((end == "s") & stem.rlike("[aeiouy].+$"), stem)
        .otherwise(w),
    )


def _snowball_rest(start: Column, r1: Column, r2: Column) -> Column:
    """All steps after the plural.

    ``r1`` and ``r2`` are the lengths of the text before the two regions; an ending lies in a
    region when the part before it is at least that long.
    """
    in_r1 = lambda s: F.length(s) >= r1
    in_r2 = lambda s: F.length(s) >= r2

    def repaired(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(stem))
            .when((r1 >= F.length(stem)) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def past(w: Column) -> Column:
        return _split(
            w,
            ["eedly", "ingly", "edly", "eed", "ing", "ed"],
            lambda stem, end: F.when(
                end.isin("eed", "eedly"),
                F.when(in_r1(stem), F.concat(stem, F.lit("ee"))).otherwise(w),
            )
            .when(stem.rlike("[aeiouy]"), repaired(stem))
            .otherwise(w),
        )

    return _chain(
        start,
        past,
        lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"),
        lambda w: _rewrite(
            w,
            SNOWBALL_2,
            lambda s, e: in_r1(s)
            & ((e != "ogi") | s.rlike("l$"))
            & ((e != "li") | s.rlike("[cdeghkmnrt]$")),
        ),
        lambda w: _rewrite(w, SNOWBALL_3, lambda s, e: in_r1(s) & ((e != "ative") | in_r2(s))),
        lambda w: _rewrite(
            w,
            dict.fromkeys(SNOWBALL_4, ""),
            lambda s, e: in_r2(s) & ((e != "ion") | s.rlike("[st]$")),
        ),
        lambda w: _rewrite(
            w,
            {"e": "", "l": ""},
            lambda s, e: F.when(
                e == "e", in_r2(s) | (in_r1(s) & ~s.rlike(SHORT_END))
            ).otherwise(in_r2(s) & s.rlike("l$")),
        ),
        F.lower,
    )


def snowball(word: Column) -> Column:
    """Stem of a lower-case word by the Snowball English algorithm."""
    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"

    def before_region(w: Column) -> Column:
        found = F.length(F.regexp_extract(w, f"({region})", 1))
        return F.when(w.rlike(region), found).otherwise(F.length(w))

    def with_regions(w: Column) -> Column:
        r1 = F.when(
            w.rlike("^(gener|commun|arsen)"), F.length(F.regexp_extract(w, "^(gener|commun|arsen)", 1))
        ).otherwise(before_region(w))
        return _let(
            r1,
            lambda a: _let(
                a + _let(F.substring(w, a + 1, F.length(w)), before_region),
                lambda b: _let(
                    _snowball_plural(w),
                    lambda v: F.when(v.isin(SNOWBALL_KEPT), v).otherwise(_snowball_rest(v, a, b)),
                ),
            ),
        )

    special = F.create_map(*[F.lit(x) for pair in SNOWBALL_WORDS.items() for x in pair])
    stem = _chain(
        word,
        lambda w: F.regexp_replace(w, "^'|('s'|'s|')$", ""),
        lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"),
        with_regions,
    )
    return (
        F.when(F.length(word) <= 2, word)
        .when(word.isin(list(SNOWBALL_WORDS)), F.try_element_at(special, word))
        .otherwise(stem)
    )


def stems(tokens: Column, stem: Body = snowball) -> Column:
    """Every token of an array replaced by its stem."""
    return F.transform(tokens, stem)
