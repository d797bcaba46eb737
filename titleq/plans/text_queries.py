"""Cleaning, tokens and row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, stems, text, words
from ..operators import features, lexicon
from . import sql
from .catalog import products, table
from .registry import query


def _title(fn, sep=" "):
    """Query for an array function of the title: the tokens joined, and how many there are."""

    def run(spark, sf_dir):
        df = products(spark, sf_dir).select("index", fn(F.col("title")).alias("tokens"))
        return df.select(
            "index",
            F.size("tokens").cast("long").alias("n"),
            F.array_join("tokens", sep).alias("tokens"),
        )

    return run


def _title_sql(tokens, sep=" "):
    return f"""WITH {sql.PRODUCTS}, t AS (SELECT index, {tokens} AS tokens FROM products)
SELECT index, len(tokens) AS n, {sql.joined("tokens", sep)} AS tokens FROM t"""


@query(
    "txt_strip_special",
    f"""WITH {sql.PRODUCTS} SELECT index,
  regexp_replace(title, '[''"</&\\[+>()\\-]', ' ', 'g') AS title_sp,
  regexp_replace(description, '[''"</&\\[+>()\\-]', ' ', 'g') AS des_sp FROM products""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index",
        text.strip_special(F.col("title")).alias("title_sp"),
        text.strip_special(F.col("description")).alias("des_sp"),
    )


@query(
    "txt_two_step_replace",
    f"""WITH {sql.PRODUCTS} SELECT index,
  regexp_replace(regexp_replace(title, '[-/()]+', ' ', 'g'), '[''.]+', '', 'g') AS title_no_sc,
  regexp_replace(regexp_replace(description, '[-/()]+', ' ', 'g'), '[''.]+', '', 'g') AS desc_no_sc
FROM products""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index",
        text.two_step_replace(F.col("title")).alias("title_no_sc"),
        text.two_step_replace(F.col("description")).alias("desc_no_sc"),
    )


@query(
    "txt_strip_digits",
    f"""WITH {sql.PRODUCTS} SELECT index, regexp_replace(title, '[0-9]+', ' ', 'g') AS title,
  regexp_replace(description, '[0-9]+', ' ', 'g') AS description FROM products""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index",
        text.strip_digits(F.col("title")).alias("title"),
        text.strip_digits(F.col("description")).alias("description"),
    )


#: Tags as in functions.html, without possessive marks.
_TAG_SQL = f"{html.START_TAG}|{html.OTHER_TAG}".replace("'", "''")
for _mark in "+*?":
    _TAG_SQL = _TAG_SQL.replace(f"{_mark}+", _mark)


def _bare_sql(c: str) -> str:
    """Text without markup, and the references that occur in the given tables."""
    bare = (
        f"regexp_replace(regexp_replace(regexp_replace({c}, '<!--.*?-->', '', 'gs'), "
        f"'<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>', '', 'gsi'), '{_TAG_SQL}', '', 'gs')"
    )
    for name, sign in (("copy", "chr(169)"), ("middot", "chr(183)"), ("quot", "chr(34)"), ("amp", "'&'")):
        bare = f"replace({bare}, '&{name};', {sign})"
    return bare


@query("txt_html_to_text", f"SELECT page_id, {_bare_sql('html')} AS plain FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", html.html_to_text(F.col("html")).alias("plain")
    )


query("txt_ws_tokens", _title_sql(sql.ws_tokens("title"), "|"))(_title(text.ws_tokens, "|"))
query("txt_word_tokens", _title_sql(sql.words("title")))(_title(text.words))
query("txt_stop_words", _title_sql(sql.nonstop(sql.words("title"))))(_title(text.useful_words))
query(
    "txt_stop_words_custom",
    _title_sql(
        f"list_filter({sql.words('title')}, "
        f"lambda x: NOT list_contains([{sql.quoted(words.TOPIC_STOP_WORDS)}], x))"
    ),
)(_title(lambda c: text.without(text.words(c), words.TOPIC_STOP_WORDS)))
query(
    "txt_title_words",
    _title_sql(
        "list_transform("
        + sql.nonstop(
            "list_filter(regexp_split_to_array(translate(title, "
            "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
        )
        + ", lambda x: lower(x))"
    ),
)(_title(text.title_words))
query(
    "txt_fold_tokens",
    _title_sql(
        sql.nonstop(
            "list_filter(regexp_split_to_array(strip_accents(title), '[^a-zA-Z0-9_]'), "
            "lambda x: x <> '')"
        )
    ),
)(_title(text.fold_tokens))



@query(
    "txt_concat_tokens",
    f"""WITH {sql.TOKENS}
SELECT index, len(nsw) + len(nd) AS n, {sql.joined("list_concat(nsw, nd)")} AS sentence FROM toks""",
)
def _(spark, sf_dir):
    both = F.concat(
        text.useful_words(F.col("title")), text.useful_words(text.text("description"))
    )
    df = products(spark, sf_dir).select("index", both.alias("tokens"))
    return df.select(
        "index", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("sentence")
    )


# ---- stems --------------------------------------------------------------------------------------


def _porter_sql(source: str) -> str:
    """CTE ``stemmed(token, stem)`` from ``source``, a table of distinct lower-case tokens."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1 = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}"
    one, cvc, vow = f"^({c})?{v}{c}({v})?$", f"^{c}[aeiouy][^aeiouwxy]$", f"^({c})?[aeiouy]"

    def has(x, p):
        return f"regexp_matches({x}, '{p}')"

    def rules(table, guard):
        """CASE over the endings, longest first: the first that fits decides."""
        arms = []
        for end in sorted(table, key=len, reverse=True):
            s = f"left(w, length(w) - {len(end)})"
            arms.append(
                f"WHEN ends_with(w, '{end}') THEN CASE WHEN {guard(s, end)} "
                f"THEN {s} || '{table[end]}' ELSE w END"
            )
        return "CASE " + " ".join(arms) + " ELSE w END"

    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) "
        "WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has('left(w, length(w) - 3)', m0)} "
        "THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN ends_with(w, 'ed') THEN CASE WHEN {has('left(w, length(w) - 2)', vow)} "
        "THEN left(w, length(w) - 2) || '#' ELSE w END "
        f"WHEN ends_with(w, 'ing') THEN CASE WHEN {has('left(w, length(w) - 3)', vow)} "
        "THEN left(w, length(w) - 3) || '#' ELSE w END ELSE w END",
        "CASE WHEN NOT ends_with(w, '#') THEN w "
        f"WHEN {has('w', '(at|bl|iz)#$')} THEN replace(w, '#', 'e') "
        "WHEN length(w) > 2 AND w[-2] = w[-3] AND "
        f"{has('w', '[bcdfghjkmnpqrtvwx]#$')} THEN left(w, length(w) - 2) "
        f"WHEN {has('left(w, length(w) - 1)', one)} AND {has('left(w, length(w) - 1)', cvc)} "
        "THEN replace(w, '#', 'e') ELSE replace(w, '#', '') END",
        rules({"y": "i"}, lambda s, e: has(s, vow)),
        rules(stems.PORTER_2, lambda s, e: has(s, m0)),
        rules(stems.PORTER_3, lambda s, e: has(s, m0)),
        rules(
            dict.fromkeys(stems.PORTER_4, ""),
            lambda s, e: has(s, m1) + (f" AND {has(s, '[st]$')}" if e == "ion" else ""),
        ),
        rules({"e": ""}, lambda s, e: f"({has(s, m1)} OR ({has(s, one)} AND NOT {has(s, cvc)}))"),
        f"CASE WHEN ends_with(w, 'll') AND {has('w', m1)} THEN left(w, length(w) - 1) ELSE w END",
    ]
    parts, last = [], source
    for i, step in enumerate(steps):
        w = "token" if i == 0 else "w"
        inner = f"(SELECT token, {w} AS w FROM {last})"
        parts.append(f"s{i} AS (SELECT token, {step} AS w FROM {inner})")
        last = f"s{i}"
    parts.append(
        "stemmed AS MATERIALIZED (SELECT token, "
        f"CASE WHEN length(token) <= 2 THEN token ELSE w END AS stem FROM {last})"
    )
    return ", ".join(parts)


def _snowball_sql(source: str) -> str:
    """CTE ``snow(token, stem)`` from ``source``, a table of distinct lower-case tokens."""
    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    short = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"

    def has(x, p):
        return f"regexp_matches({x}, '{p}')"

    def before(n):
        return f"left(w, length(w) - {n})"

    def in_r1(n):
        return f"length(w) - {n} >= r1"

    def in_r2(n):
        return f"length(w) - {n} >= r2"

    def rules(table, guard):
        arms = []
        for end in sorted(table, key=len, reverse=True):
            arms.append(
                f"WHEN ends_with(w, '{end}') THEN CASE WHEN {guard(end)} "
                f"THEN {before(len(end))} || '{table[end]}' ELSE w END"
            )
        return "CASE " + " ".join(arms) + " ELSE w END"

    def second(end):
        more = {"ogi": f" AND {has(before(3), 'l$')}", "li": f" AND {has(before(2), '[cdeghkmnrt]$')}"}
        return in_r1(len(end)) + more.get(end, "")

    def last(end):
        if end == "l":
            return f"{in_r2(1)} AND {has(before(1), 'l$')}"
        return f"({in_r2(1)} OR ({in_r1(1)} AND NOT {has(before(1), short)}))"

    past = "CASE "
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        n = len(end)
        if end.startswith("eed"):
            done = f"CASE WHEN {in_r1(n)} THEN {before(n)} || 'ee' ELSE w END"
        else:
            done = f"CASE WHEN {has(before(n), '[aeiouy]')} THEN {before(n)} || '#' ELSE w END"
        past += f"WHEN ends_with(w, '{end}') THEN {done} "
    past += "ELSE w END"
    bare = before(1)
    steps = [
        "CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) "
        "WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') "
        "THEN left(w, length(w) - 3) || CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END "
        "WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w "
        f"WHEN ends_with(w, 's') AND {has(bare, '[aeiouy].+$')} THEN {bare} ELSE w END",
        past,
        "CASE WHEN NOT ends_with(w, '#') THEN w "
        f"WHEN {has(bare, '(at|bl|iz)$')} THEN {bare} || 'e' "
        f"WHEN {has(bare, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN left(w, length(w) - 2) "
        f"WHEN r1 >= length(w) - 1 AND {has(bare, short)} THEN {bare} || 'e' ELSE {bare} END",
        "regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i')",
        rules(stems.SNOWBALL_2, second),
        rules(
            stems.SNOWBALL_3,
            lambda e: in_r1(len(e)) + (f" AND {in_r2(len(e))}" if e == "ative" else ""),
        ),
        rules(
            dict.fromkeys(stems.SNOWBALL_4, ""),
            lambda e: in_r2(len(e)) + (f" AND {has(before(3), '[st]$')}" if e == "ion" else ""),
        ),
        rules({"e": "", "l": ""}, last),
        "lower(w)",
    ]
    parts = [
        f"p0 AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"
        f" AS w FROM {source})",
        f"p1 AS (SELECT *, CASE WHEN {has('w', '^(gener|commun|arsen)')} "
        "THEN length(regexp_extract(w, '^(gener|commun|arsen)')) "
        f"WHEN {has('w', region)} THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS r1 FROM p0)",
        "p2 AS (SELECT *, r1 + CASE "
        f"WHEN {has('substr(w, r1 + 1)', region)} THEN length(regexp_extract(substr(w, r1 + 1), '{region}')) "
        "ELSE length(w) - r1 END AS r2 FROM p1)",
    ]
    prior = "p2"
    for i, step in enumerate(steps):
        kept = f"CASE WHEN kept IS NOT NULL THEN w ELSE {step} END" if i else step
        extra = "" if i else ", NULL AS kept"
        parts.append(f"q{i} AS (SELECT token, r1, r2, {kept} AS w{', kept' if i else extra} FROM {prior})")
        prior = f"q{i}"
        if i == 0:
            parts.append(
                f"qk AS (SELECT token, r1, r2, w, CASE WHEN w IN ({sql.quoted(stems.SNOWBALL_KEPT)}) "
                "THEN w END AS kept FROM q0)"
            )
            prior = "qk"
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stems.SNOWBALL_WORDS.items())
    parts.append(
        "snow AS MATERIALIZED (SELECT token, CASE WHEN length(token) <= 2 THEN token "
        f"ELSE CASE token {special} ELSE w END END AS stem FROM {prior})"
    )
    return ", ".join(parts)


# Stemmed word lists as (index, title_words, desc_words, cat_words).
_CATS = "list_concat(" + ", ".join(sql.words(f"category_{i}") for i in (1, 2, 3)) + ")"
_STEMMED = f"""{sql.TOKENS}, lists AS (
  SELECT index, 't' AS side, nsw AS l FROM toks UNION ALL SELECT index, 'd', nd FROM toks
  UNION ALL SELECT index, 'c', {_CATS} FROM toks),
  pos AS (SELECT index, side, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM lists),
  dist AS (SELECT DISTINCT token FROM pos), {_snowball_sql("dist")},
  first AS (SELECT index, side, token, stem, min(p) AS p FROM pos JOIN snow USING (token) GROUP BY ALL)"""


def _plain_sql(c: str) -> str:
    """Text of a value that holds a tag, as in txt_html_to_text."""
    return f"CASE WHEN regexp_matches({c}, '<[a-zA-Z!/]') THEN {_bare_sql(c)} ELSE {c} END"


def _clean_tokens_sql(c: str) -> str:
    letters = f"lower(regexp_replace({_plain_sql(c)}, '[^a-zA-Z0-9]', ' ', 'g'))"
    return sql.nonstop(f"list_filter(string_split({letters}, ' '), lambda x: x <> '')")


_CLEAN_TOKENS = f"""{sql.PRODUCTS}, clean AS (
  SELECT index, 't' AS side, {_clean_tokens_sql("title")} AS tokens FROM products
  UNION ALL SELECT index, 'd', {_clean_tokens_sql("coalesce(description, ' ')")} FROM products),
  pos AS (SELECT index, side, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM clean),
  dist AS (SELECT DISTINCT token FROM pos), {_porter_sql("dist")}"""


@query(
    "txt_clean_text",
    f"""WITH {_CLEAN_TOKENS},
  texts AS (SELECT index, string_agg(stem, ' ' ORDER BY p) FILTER (side = 't') AS t,
    string_agg(stem, ' ' ORDER BY p) FILTER (side = 'd') AS d
  FROM pos JOIN stemmed USING (token) GROUP BY index)
SELECT index, coalesce(t, '') AS clean_title, coalesce(d, '') AS clean_sd
FROM products LEFT JOIN texts USING (index)""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index",
        clean_text(F.col("title")).alias("clean_title"),
        clean_text(F.col("description"), escaped=True).alias("clean_sd"),
    )


def clean_text(c, escaped: bool = False):
    """Markup off, letters and digits only, lower case, no stop words, Porter stems, joined.

    ``escaped`` texts that start with a backslash have their backslash escapes decoded first.
    """
    c = F.coalesce(c, F.lit(" "))
    if escaped:
        c = F.when(c.startswith("\\"), html.decode_escapes(c)).otherwise(c)
    tokens = text.clean_words(html.plain_if_marked(c))
    return F.array_join(stems.stems(tokens, stems.porter), " ")


@query(
    "txt_stem_dictionary",
    f"""WITH {sql.PRODUCTS}, toks AS (SELECT unnest({sql.words("title")}) AS token FROM products
    UNION ALL SELECT unnest({sql.words("description")}) FROM products),
  dist AS (SELECT token, count(*) AS n FROM toks GROUP BY token), {_porter_sql("dist")}
SELECT token, n, stem FROM dist JOIN stemmed USING (token)""",
)
def _(spark, sf_dir):
    both = F.concat(text.words(F.col("title")), text.words(text.text("description")))
    tokens = products(spark, sf_dir).select(F.explode(both).alias("token"))
    dictionary = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return dictionary.withColumn("stem", stems.porter(F.col("token")))


@query(
    "txt_snowball_stems",
    f"""WITH {_STEMMED}, texts AS (
  SELECT index, string_agg(stem, ' ' ORDER BY p) FILTER (side = 't') AS t,
    string_agg(stem, ' ' ORDER BY p) FILTER (side = 'd') AS d
  FROM pos JOIN snow USING (token) GROUP BY index),
  cats AS (SELECT index, string_agg(stem, ' ' ORDER BY p) AS c FROM first WHERE side = 'c' GROUP BY index)
SELECT toks.index, coalesce(t, '') AS title_words, coalesce(d, '') AS desc_words,
  coalesce(c, '') AS cat_words
FROM toks LEFT JOIN texts USING (index) LEFT JOIN cats USING (index)""",
)
def _(spark, sf_dir):
    lists = features.word_lists(products(spark, sf_dir), stemmed=True)
    return lists.select(
        "index",
        *[F.array_join(c, " ").alias(c) for c in ("title_words", "desc_words", "cat_words")],
    )


# ---- features -----------------------------------------------------------------------------------


@query(
    "feat_char_count",
    f"""WITH {sql.PRODUCTS} SELECT index, length(title) AS title_character_count,
  length(coalesce(description, '')) AS description_character_count FROM products""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index",
        F.length("title").cast("long").alias("title_character_count"),
        F.length(text.text("description")).cast("long").alias("description_character_count"),
    )


def _concise(*columns):
    """Query for some columns of the conciseness features."""

    def run(spark, sf_dir):
        df = features.concise_features(products(spark, sf_dir))
        kinds = dict(df.dtypes)
        return df.select(
            "index",
            *[(F.col(c).cast("long") if kinds[c] == "int" else F.col(c)).alias(c) for c in columns],
        )

    return run


def _concise_sql(*columns):
    return f"WITH {sql.CONCISE} SELECT index, {', '.join(columns)} FROM concise_features"


for _name, _columns in {
    "feat_token_counts": ("original_tokens", "regex_tokens", "sw_tokens", "nsw_tokens", "des_tokens"),
    "feat_title_desc_ratio": ("tit_des_ratio",),
    "feat_des_same": ("des_same",),
    "feat_repeat_tokens": ("repeat_tokens",),
    "feat_concise_all": (
        "original_tokens", "des_same", "nsw_tokens", "sw_tokens", "regex_tokens", "tit_des_ratio",
        "repeat_tokens", "title_character_count",
    ),
}.items():
    query(_name, _concise_sql(*_columns))(_concise(*_columns))


@query(
    "feat_des_same_plain",
    f"""WITH {sql.PRODUCTS} SELECT index,
  {sql.common(sql.words("title"), sql.words("coalesce(description, '')"))} AS des_same FROM products""",
)
def _(spark, sf_dir):
    same = features.overlap(text.words(F.col("title")), text.words(text.text("description")))
    return products(spark, sf_dir).select("index", same.cast("long").alias("des_same"))


@query(
    "feat_title_des_dup",
    f"WITH {sql.TOKENS} SELECT index, {sql.common('nsw', 'nd')} AS title_des_dup FROM toks",
)
def _(spark, sf_dir):
    lists = features.word_lists(products(spark, sf_dir))
    same = features.overlap(F.col("title_words"), F.col("desc_words"))
    return lists.select("index", same.cast("long").alias("title_des_dup"))


@query(
    "feat_title_cat_same",
    f"""WITH {sql.TOKENS} SELECT index, {sql.common("nsw", "list_concat(" + ", ".join(
        sql.words(f"category_{i}") for i in (1, 2, 3)) + ")")} AS title_cat_same FROM toks""",
)
def _(spark, sf_dir):
    lists = features.word_lists(products(spark, sf_dir))
    same = features.overlap(F.col("title_words"), F.col("cat_words"))
    return lists.select("index", same.cast("long").alias("title_cat_same"))


@query(
    "feat_stem_overlap",
    f"""WITH {_STEMMED}, u AS (SELECT DISTINCT index, side, stem FROM first),
  o AS (SELECT a.index, count(*) FILTER (b.side = 'd') AS d, count(*) FILTER (b.side = 'c') AS c
    FROM u a JOIN u b ON a.index = b.index AND a.stem = b.stem AND a.side = 't' AND b.side <> 't'
    GROUP BY a.index)
SELECT toks.index, coalesce(d, 0) AS title_des_dup, coalesce(c, 0) AS title_cat_same
FROM toks LEFT JOIN o USING (index)""",
)
def _(spark, sf_dir):
    lists = features.word_lists(products(spark, sf_dir), stemmed=True)
    des = features.overlap(F.col("title_words"), F.col("desc_words"))
    cat = features.overlap(F.col("title_words"), F.col("cat_words"))
    return lists.select(
        "index", des.cast("long").alias("title_des_dup"), cat.cast("long").alias("title_cat_same")
    )


@query(
    "feat_special_chars",
    f"""WITH {sql.PRODUCTS}
SELECT index, length(regexp_replace(title, '[a-zA-Z0-9 ]', '', 'g')) AS special_chars FROM products""",
)
def _(spark, sf_dir):
    n = features.special_char_count(F.col("title"))
    return products(spark, sf_dir).select("index", n.cast("long").alias("special_chars"))


def _tag_sql(t: str) -> str:
    def ends(endings):
        return f"regexp_matches({t}, '[a-z]{{2}}({'|'.join(endings)})$')"

    def among(items):
        return f"{t} IN ({sql.quoted(items)})"

    return f"""CASE
    WHEN regexp_matches({t}, '^[0-9][0-9_]*$') OR {among(words.NUMBER_WORDS)} THEN 'NUM'
    WHEN {among('$%+=<>~^&#@|*/')} THEN 'SYM'
    WHEN NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}_]') THEN 'PUNCT'
    WHEN {among(words.CONJUNCTIONS)} THEN 'CCONJ'
    WHEN {among(words.FUNCTION_WORDS)} THEN 'FUNC'
    WHEN {ends(words.ADVERB_ENDINGS)} THEN 'ADV'
    WHEN {among(words.ADJECTIVES)} OR {ends(words.ADJECTIVE_ENDINGS)} THEN 'ADJ'
    WHEN {ends(words.VERB_ENDINGS)} THEN 'VERB' ELSE 'NOUN' END"""


RAW_TOKENS = r"regexp_extract_all(title, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"

TAGGED = f"""{sql.PRODUCTS}, lists AS (SELECT index, {RAW_TOKENS} AS l FROM products),
  raw AS (SELECT index, unnest(l) AS token, generate_subscripts(l, 1) AS place FROM lists),
  tagged AS (SELECT index, place, token, {_tag_sql("lower(token)")} AS tag FROM raw),
  tag_counts AS (
    SELECT index, count(*) AS words, count(*) FILTER (tag = 'NUM') AS count_num,
      count(*) FILTER (tag = 'ADJ') AS count_adj, count(*) FILTER (tag IN ('NOUN', 'PROPN')) AS count_noun,
      count(*) FILTER (tag IN ('SYM', 'CCONJ')) AS count_conj
    FROM tagged GROUP BY index)"""


@query(
    "feat_tag_counts",
    f"""WITH {TAGGED} SELECT p.index, """
    + ", ".join(
        f"coalesce(count_{k}, 0) AS count_{k}, coalesce(count_{k} / words, 0.0) AS freq_{k}"
        for k in ("num", "adj", "noun", "conj")
    )
    + " FROM products p LEFT JOIN tag_counts t ON t.index = p.index",
)
def _(spark, sf_dir):
    counts = features.tag_counts(products(spark, sf_dir))
    kinds = ("num", "adj", "noun", "conj")
    return counts.select(
        "index",
        *[F.col(f"count_{k}").cast("long").alias(f"count_{k}") for k in kinds],
        *[f"freq_{k}" for k in kinds],
    )


def _part_titles(spark, sf_dir):
    title = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("index"), F.split(F.lower(title), " ").alias("tokens")
    )


def _brands(spark, sf_dir):
    return (
        table(spark, sf_dir, "part").select(F.lower("p_brand").alias("token")).distinct()
    )


def color_table(spark):
    return spark.createDataFrame([(c,) for c in words.COLORS], "token string")


@query(
    "feat_lexicon_counts",
    f"""WITH brands AS (SELECT DISTINCT lower(p_brand) AS token FROM part),
  t AS (SELECT p_partkey AS index, unnest(string_split(lower(p_name || ' ' || p_brand), ' ')) AS token
    FROM part)
SELECT index, count(*) FILTER (token IN ({sql.quoted(words.COLORS)})) AS count_color,
  count(*) FILTER (token IN (SELECT token FROM brands)) AS count_brand, count(*) AS count_words,
  sum(length(token))::BIGINT AS count_chars,
  count(*) FILTER (token IN ({sql.quoted(words.COLORS)})) / count(*) AS freq_color,
  count(*) FILTER (token IN (SELECT token FROM brands)) / count(*) AS freq_brand
FROM t GROUP BY index""",
)
def _(spark, sf_dir):
    counts = lexicon.lexicon_counts(
        _part_titles(spark, sf_dir), {"color": color_table(spark), "brand": _brands(spark, sf_dir)}
    )
    return counts.select(
        "index",
        *[F.col(c).cast("long").alias(c) for c in ("count_color", "count_brand", "count_words", "count_chars")],
        "freq_color",
        "freq_brand",
    )


def language_topics(spark, sf_dir, k=30):
    """The ``k`` most frequent title words per language, standing in for learnt topics."""
    rows = products(spark, sf_dir).select(
        "category_3", F.explode(text.useful_words(F.col("title"))).alias("token")
    )
    return lexicon.top_terms(rows, "category_3", k)


TOPICS = f"""lw AS (SELECT category_3, unnest(nsw) AS token FROM toks),
  lc AS (SELECT category_3, token, count(*) AS c FROM lw GROUP BY ALL),
  topics AS (SELECT category_3 AS topic, token AS term FROM (SELECT *, row_number() OVER (
    PARTITION BY category_3 ORDER BY c DESC, token) AS r FROM lc) WHERE r <= 30),
  tw AS (SELECT DISTINCT index, unnest(nsw) AS token FROM toks),
  hits AS (SELECT index, topic, count(*) AS h FROM tw JOIN topics ON token = term GROUP BY ALL),
  topic_features AS (SELECT index, max(h) AS max_words_topic, count(*) AS topic_num FROM hits GROUP BY index)"""


@query(
    "feat_topic_overlap",
    f"""WITH {sql.TOKENS}, {TOPICS}
SELECT t.index, coalesce(max_words_topic, 0) AS max_words_topic, coalesce(topic_num, 0) AS topic_num,
  CASE WHEN len(nsw) = 0 THEN 0.0 ELSE coalesce(max_words_topic, 0) / len(nsw) END AS max_words_topic_freq
FROM toks t LEFT JOIN topic_features f ON f.index = t.index""",
)
def _(spark, sf_dir):
    topics = lexicon.topic_lists(language_topics(spark, sf_dir))
    titles = products(spark, sf_dir).select(
        "index", text.useful_words(F.col("title")).alias("tokens")
    )
    found = lexicon.topic_overlap(titles, "tokens", topics)
    share = F.coalesce(F.try_divide(F.col("max_words_topic"), F.size("tokens")), F.lit(0.0))
    return found.select(
        "index",
        F.col("max_words_topic").cast("long").alias("max_words_topic"),
        F.col("topic_num").cast("long").alias("topic_num"),
        share.alias("max_words_topic_freq"),
    )
