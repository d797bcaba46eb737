"""HTML to text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A start tag: its name, then blanks and slashes, or attributes, whose quoted values may hold ">". "<" before
#: anything but a letter, "/", "!" or "?" is text.
START_TAG = (
    r"""<[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+"""
    r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+>"""
)
OTHER_TAG = r"</[^>]++>|<[!?][^>]*+>"
_NAMES = sorted({n.rstrip(";") for n in html5 if not n.endswith(";")}, key=lambda n: (-len(n), n))
#: A reference at the start of a piece; old names need no semicolon.
_ENTITY = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|" + "|".join(_NAMES) + ")"


def strip_tags(c: Column) -> Column:
    """Comments, scripts, styles and tags taken out."""
    bare = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>", "")
    return F.regexp_replace(bare, START_TAG + "|" + OTHER_TAG, "")


def _character(code: Column) -> Column:
    """The character of a code point given as an integer column."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered() -> dict[int, str]:
    """Code points from 128 to 159 mean what they mean in the Windows code page, where it has a sign."""
    return {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}


def decode_entities(c: Column) -> Column:
    """Character references replaced in one pass, so ``&amp;lt;`` gives ``&lt;``.

    Numbers that name no character give the replacement sign, unknown names stay as they are.
    """
    # One constant; a lookup walks it from the start, so frequent names come first.
    frequent = dict.fromkeys([*(f"{n};" for n in ("amp", "quot", "lt", "gt", "nbsp")), *sorted(html5, key=len)])
    named = F.from_json(F.lit(json.dumps({n: html5[n] for n in frequent})), "map<string,string>")
    windows = F.create_map(*[F.lit(x) for n, sign in _numbered().items() for x in (n, sign)])

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, _ENTITY, 1)
        digits = F.regexp_replace(name, "[;#xX]", "")
        # Numbers of more than nine digits are no characters and need not be read.
        short = F.length(F.ltrim(digits, F.lit("0"))) < 10
        code = F.when(~short, 1 << 31).when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(
            digits.try_cast("long")
        )
        wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(wrong, "\ufffd").otherwise(F.coalesce(F.try_element_at(windows, code.cast("int")), _character(code)))
        sign = F.when(name.startswith("#"), number).otherwise(F.try_element_at(named, name))
        rest = F.regexp_replace(p, _ENTITY, "")
        return F.when((name == "") | sign.isNull(), p).otherwise(F.concat(sign, rest))

    decoded = F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def html_to_text(c: Column) -> Column:
    return decode_entities(strip_tags(c))


def plain_if_marked(c: Column) -> Column:
    """Text of a value that holds a tag; other values stay as they are, references included."""
    return F.when(c.rlike("<[a-zA-Z!/]"), html_to_text(c)).otherwise(c)


_ESCAPE = r"(?s)(\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)|[^\\]+|\\$)"
# Letters after a backslash and the code points they stand for (fixed values).
_ESCAPE_CODES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


def decode_escapes(c: Column) -> Column:
    """Backslash escapes replaced in one pass; unknown escapes stay."""
    letters = F.create_map(*[F.lit(x) for a, n in _ESCAPE_CODES.items() for x in (a, chr(n))])

    def piece(p: Column) -> Column:
        body = F.substring(p, 2, 9)
        return (
            F.when(~p.startswith("\\"), p)
            .when(body.rlike("^[xuU][0-9a-fA-F]{2,8}$"),
                  _character(F.conv(F.substring(p, 3, 8), 16, 10).cast("long")))
            .when(body.rlike("^[0-7]{1,3}$"), _character(F.conv(body, 8, 10).cast("long")))
            .when(body.isin("\\", "'", '"'), body)
            .otherwise(F.coalesce(F.try_element_at(letters, body), p))
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_ESCAPE), F.lit(1)), piece), "")
