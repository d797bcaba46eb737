"""Pieces of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import BLANKS, SPECIAL
from ..functions.words import STOP_WORDS
from ..schemas import CATEGORIES, SEGMENT_A


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


BLANK_CHARS = " || ".join(f"chr({ord(c)})" for c in BLANKS)
STOPS = f"[{quoted(STOP_WORDS)}]"
SEG_A = f"coalesce(category_1 IN ({quoted(SEGMENT_A)}), false)"

PRODUCTS = f"""products AS (
  SELECT doc_id + 1 AS index, split_part(text, chr(10), 1) AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS description,
    list_extract([{quoted(CATEGORIES)}], 1 + CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 9)
      AS category_1,
    source AS category_2, lang AS category_3, n_chars
  FROM documents)"""

LABELS = """lab AS (SELECT doc_id + 1 AS index, quality AS concise, 1 - toxic AS clarity FROM labels)"""

SCORED = f"""{PRODUCTS}, {LABELS}, scored AS (
  SELECT index, category_1, concise AS label, least(1.0, round(n_chars / 5000.0, 3))::DOUBLE AS score,
    CASE WHEN round(n_chars / 5000.0, 3) > 0.1 THEN 1 ELSE 0 END AS prediction
  FROM products JOIN lab USING (index))"""


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]'), lambda x: x <> '')"


def nonstop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: NOT list_contains({STOPS}, x))"


def strip_special(c: str) -> str:
    return f"regexp_replace({c}, {quoted([SPECIAL])}, ' ', 'g')"


def ws_tokens(c: str) -> str:
    cut = f"rtrim(lower({c}), {BLANK_CHARS})"
    return (
        f"CASE WHEN {c} = '' THEN [''] WHEN {cut} = '' THEN CAST([] AS VARCHAR[]) "
        f"ELSE regexp_split_to_array({cut}, '[ \\t\\n\\x0B\\f\\r]') END"
    )


def joined(tokens: str, sep: str = " ") -> str:
    return f"array_to_string({tokens}, '{sep}')"


def common(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


TOKENS = f"""{PRODUCTS}, tok AS (
  SELECT index, category_1, category_2, category_3, title, coalesce(description, '') AS des,
    {ws_tokens(strip_special("title"))} AS ws, {words("title")} AS w
  FROM products), toks AS (
  SELECT *, {nonstop("w")} AS nsw, {nonstop(words("des"))} AS nd FROM tok)"""

CONCISE = f"""{TOKENS}, concise_features AS (
  SELECT index, category_1, len(ws) AS original_tokens,
    greatest(0, len(ws) - len(w)) AS regex_tokens,
    greatest(0, len(ws) - len(nsw)) - greatest(0, len(ws) - len(w)) AS sw_tokens,
    len(nsw) AS nsw_tokens, len(nd) AS des_tokens,
    CASE WHEN len(nd) = 0 THEN 1.0 ELSE len(nsw)::DOUBLE / len(nd) END AS tit_des_ratio,
    {common("w", "nd")} AS des_same,
    len(nsw) - len(list_distinct(nsw)) AS repeat_tokens,
    length(title) AS title_character_count
  FROM toks)"""

# Word vectors: number of a word's vector, vectors with their lengths, all cosines.
VECTORS = """n AS (SELECT count(*) AS n FROM embeddings),
  unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
  cosines AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS sim
    FROM unit a, unit b)"""


def vec_id(token: str) -> str:
    return f"(('0x' || substr(md5({token}), 1, 8))::BIGINT % (SELECT n + n // 10 FROM n))"


# Known words of each side as (index, side, v, c): vector number and repetitions.
SIDE_VECTORS = f"""sides AS (
  SELECT index, 't' AS side, unnest(nsw) AS token FROM toks
  UNION ALL SELECT index, 'd', unnest(nd) FROM toks),
  sv AS MATERIALIZED (
    SELECT index, side, v, count(*) AS c FROM (SELECT index, side, {vec_id("token")} AS v FROM sides)
    WHERE v < (SELECT n FROM n) GROUP BY index, side, v)"""
