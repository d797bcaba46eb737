"""Similarity of titles and descriptions, word-vector sums, and the table of all 22 features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, lexicon, similarity
from ..schemas import CLARITY_FEATURES
from ..session import scratch_path, written
from ..sources import readers, writers
from . import sql
from .catalog import products, table, word_vectors
from .registry import query
from .text_queries import TAGGED, TOPICS, language_topics


def _title():
    return text.useful_words(F.col("title"))


def _description():
    return text.useful_words(text.text("description"))


def _words(spark, sf_dir) -> DataFrame:
    return similarity.side_words(products(spark, sf_dir, False), _title(), _description())


def _pairs(spark, sf_dir) -> DataFrame:
    return similarity.paired_words(products(spark, sf_dir, False), _title(), _description())


def _long(words: DataFrame) -> DataFrame:
    """Words of at least two characters, the only ones the TF-IDF scores look at.

    Shorter words turn into the null word, so that no index is lost.
    """
    return words.withColumn("token", F.when(F.length("token") >= 2, F.col("token")))


def _texts(spark, sf_dir):
    """Number of titles and descriptions, as a one-value subquery."""
    return table(spark, sf_dir, "documents").agg(F.count("*") * 2).scalar()


def _every(spark, sf_dir, scores: DataFrame) -> DataFrame:
    """The scores of all products, null where there is none."""
    rows = products(spark, sf_dir, False).select("index")
    return rows.join(scores, "index", "left")


# Cosine over (index, token, a, b) rows: weights of title and description words.
def _cosine_sql(name: str, digits: int | None = 9) -> str:
    score = "coalesce(s, 0.0)" if digits is None else f"round(coalesce(s, 0.0), {digits})"
    return (
        f"SELECT p.index, {score} AS {name} FROM products p LEFT JOIN ("
        "SELECT index, CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 "
        "THEN sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0.0 END AS s "
        "FROM weights GROUP BY index) x ON x.index = p.index"
    )


_PAIRED = f"""{sql.TOKENS}, occ AS (
  SELECT index, unnest(nsw) AS token, 1 AS t, 0 AS d FROM toks
  UNION ALL SELECT index, unnest(nd), 0, 1 FROM toks),
  paired AS (SELECT index, token, sum(t) AS nt, sum(d) AS nd FROM occ WHERE length(token) >= 2
    GROUP BY index, token)"""

TFIDF = f"""{_PAIRED}, dfs AS (
  SELECT token, sum(CASE WHEN nt > 0 THEN 1 ELSE 0 END + CASE WHEN nd > 0 THEN 1 ELSE 0 END) AS df
  FROM paired GROUP BY token),
  idf AS (SELECT token, ln((1 + 2 * (SELECT count(*) FROM products)) / (1 + df)) + 1 AS w FROM dfs),
  weights AS (SELECT index, nt * w AS a, nd * w AS b FROM paired JOIN idf USING (token))"""


@query("sim_tfidf_corpus", f"WITH {TFIDF} {_cosine_sql('tf_score')}")
def _(spark, sf_dir):
    out = similarity.tfidf_corpus(written(_long(_pairs(spark, sf_dir)), "paired_words"), _texts(spark, sf_dir))
    return out.select("index", F.round("tf_score", 9).alias("tf_score"))


@query(
    "sim_tfidf_pair",
    f"""WITH {_PAIRED}, weights AS (
  SELECT index, nt * w AS a, nd * w AS b FROM (SELECT *, ln(3.0 / (1 + CASE WHEN nt > 0 THEN 1 ELSE 0 END
    + CASE WHEN nd > 0 THEN 1 ELSE 0 END)) + 1 AS w FROM paired))
{_cosine_sql('tf_pair_score')}""",
)
def _(spark, sf_dir):
    out = similarity.tfidf_pair(_long(_pairs(spark, sf_dir)))
    return out.select("index", F.round("tf_pair_score", 9).alias("tf_pair_score"))


PAIR_MEAN = """pair_means AS (
  SELECT t.index, sum(t.c * d.c * sim) / sum(t.c * d.c) AS w2v_score
  FROM sv t JOIN sv d ON d.index = t.index AND d.side = 'd'
    JOIN cosines ON cosines.a = t.v AND cosines.b = d.v
  WHERE t.side = 't' GROUP BY t.index)"""


@query(
    "sim_pair_mean",
    f"""WITH {sql.TOKENS}, {sql.VECTORS}, {sql.SIDE_VECTORS}, {PAIR_MEAN}
SELECT p.index, round(w2v_score, 6) AS w2v_score FROM products p LEFT JOIN pair_means m ON m.index = p.index""",
)
def _(spark, sf_dir):
    out = similarity.pair_mean(_words(spark, sf_dir), word_vectors(spark, sf_dir))
    return _every(spark, sf_dir, out).select("index", F.round("w2v_score", 6).alias("w2v_score"))


MEAN_VECTOR = """cells AS (
  SELECT index, side, generate_subscripts(vec, 1) AS i, unnest(vec) AS x, c
  FROM sv JOIN unit ON unit.vec_id = sv.v),
  sums AS (SELECT index, side, i, sum(x * c) AS x FROM cells GROUP BY ALL),
  mean_cosines AS (
    SELECT t.index, sum(t.x * d.x) / (sqrt(sum(t.x * t.x)) * sqrt(sum(d.x * d.x))) AS sp_score
    FROM sums t JOIN sums d ON d.index = t.index AND d.i = t.i AND d.side = 'd'
    WHERE t.side = 't' GROUP BY t.index)"""


@query(
    "sim_mean_vector",
    f"""WITH {sql.TOKENS}, {sql.VECTORS}, {sql.SIDE_VECTORS}, {MEAN_VECTOR}
SELECT p.index, round(sp_score, 6) AS sp_score
FROM products p LEFT JOIN mean_cosines m ON m.index = p.index""",
)
def _(spark, sf_dir):
    out = similarity.mean_vector_cosine(_words(spark, sf_dir), word_vectors(spark, sf_dir))
    return _every(spark, sf_dir, out).select("index", F.round("sp_score", 6).alias("sp_score"))


@query(
    "sim_top5_profile",
    f"""WITH {sql.TOKENS}, {sql.VECTORS}, {sql.SIDE_VECTORS},
  d AS (SELECT index, v, c, unnest(range(least(c, 5))) AS copy FROM sv WHERE side = 'd'),
  pairs AS (SELECT t.index, t.v, t.c, sim, row_number() OVER (PARTITION BY t.index, t.v ORDER BY sim DESC) AS r
    FROM sv t JOIN d ON d.index = t.index JOIN cosines ON cosines.a = t.v AND cosines.b = d.v
    WHERE t.side = 't'),
  best AS (SELECT * FROM pairs WHERE r <= 5),
  means AS (SELECT index, v, c, avg(sim) AS m FROM best GROUP BY ALL),
  line AS (
    SELECT index, m AS s, unnest(range(c)) AS copy FROM means JOIN toks USING (index) WHERE len(nsw) >= 5
    UNION ALL SELECT index, sim, unnest(range(c)) FROM best JOIN toks USING (index) WHERE len(nsw) < 5),
  filled AS (
    SELECT index, s FROM line
    UNION ALL SELECT index, 0.0 FROM (SELECT p.index, unnest(range(greatest(0, 5 - coalesce(n, 0)))) AS z
      FROM products p LEFT JOIN (SELECT index, count(*) AS n FROM line GROUP BY index) l ON l.index = p.index)),
  ranked AS (SELECT index, s, row_number() OVER (PARTITION BY index ORDER BY s DESC) AS r FROM filled)
SELECT index, {", ".join(f"round(max(s) FILTER (r = {i}), 6) AS s{i}" for i in range(1, 6))}
FROM ranked WHERE r <= 5 GROUP BY index""",
)
def _(spark, sf_dir):
    out = similarity.top5_profile(
        written(_words(spark, sf_dir), "side_words"), word_vectors(spark, sf_dir)
    )
    return out.select("index", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(1, 6)])


@query(
    "vec_title_sum",
    f"""WITH {sql.PRODUCTS}, {sql.VECTORS},
  tw AS (SELECT index, unnest({sql.nonstop(sql.words("title"))}) AS token FROM products),
  cells AS (SELECT index, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x
    FROM tw JOIN unit ON unit.vec_id = {sql.vec_id("token")})
SELECT index, pos, round(sum(x), 5) AS value FROM cells GROUP BY index, pos""",
)
def _(spark, sf_dir):
    titles = products(spark, sf_dir, False).select("index", "title")
    sums = similarity.text_vector(titles, _title(), word_vectors(spark, sf_dir))
    cells = sums.select("index", F.posexplode("vec").alias("pos", "value"))
    return cells.select(
        "index", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value")
    )


# ---- the full feature table ---------------------------------------------------------------------

#: Words of the benchmark items stand in for the lexicons, as they occur in titles: short ones for colours, long
#: ones for brands. The numbers are lengths.
LEXICONS = {"color": (2, 4), "brand": (5, 40)}


def lexicon_file(spark, sf_dir, name: str) -> DataFrame:
    """A lexicon written to a file, one word per line, and read back."""
    low, high = LEXICONS[name]
    token = F.explode(text.words(text.text("text"))).alias("token")
    rows = table(spark, sf_dir, "benchmark").select(token).distinct().where(F.length("token").between(low, high))
    path = scratch_path(spark, f"{name}.txt")
    writers.write_lines(rows, F.col("token"), "token", path, "\r\n")
    return readers.read_lexicon(spark, path)


def clarity_frame(spark, sf_dir) -> DataFrame:
    """One row per product with the 22 clarity features.

    Row features come from one projection. The scores are computed apart and joined by
    index; absent scores count as 0.
    """
    df = products(spark, sf_dir)
    topics = lexicon.topic_lists(language_topics(spark, sf_dir))
    lexicons = {name: lexicon_file(spark, sf_dir, name) for name in LEXICONS}
    plain = products(spark, sf_dir, False)
    vectors = word_vectors(spark, sf_dir)

    row = features.tag_counts(df).select(
        "index",
        *[f"{k}_{c}" for c in ("num", "adj", "noun", "conj") for k in ("count", "freq")],
        _title().alias("_title"),
        _description().alias("_des"),
        F.array_union(
            F.array_union(text.words(F.col("category_1")), text.words(F.col("category_2"))),
            text.words(F.col("category_3")),
        ).alias("_cat"),
    )
    row = lexicon.topic_overlap(row, "_title", topics)
    row = row.withColumns(
        {
            "max_words_topic_freq": F.coalesce(
                F.try_divide(F.col("max_words_topic"), F.size("_title")), F.lit(0.0)
            ),
            "title_cat_dup": features.overlap(F.col("_title"), F.col("_cat")),
            "title_des_dup": features.overlap(F.col("_title"), F.col("_des")),
        }
    ).drop("_title", "_des", "_cat")
    listed = lexicon.lexicon_counts(
        plain.select("index", text.words(F.col("title")).alias("tokens")), lexicons
    )
    pairs = written(_pairs(spark, sf_dir), "paired_words")
    scores = [
        similarity.vector_scores(pairs, vectors),
        similarity.tfidf_corpus(_long(pairs), _texts(spark, sf_dir)),
    ]
    joined = reduce(lambda a, b: a.join(b, "index", "left"), [row, listed, *scores])
    return joined.select(
        "index", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CLARITY_FEATURES]
    )


_LISTED = f"""lexicon AS (SELECT DISTINCT unnest({sql.words("coalesce(text, '')")}) AS token FROM benchmark),
  wt AS (SELECT index, unnest(w) AS token FROM toks),
  listed AS (SELECT index, count(*) AS count_words, sum(length(token)) AS count_chars,
    {", ".join(f"count(*) FILTER (token IN (SELECT token FROM lexicon WHERE length(token) BETWEEN {a} AND {b})) AS count_{name}"
               for name, (a, b) in LEXICONS.items())} FROM wt GROUP BY index)"""

_ZERO = {c: f"coalesce({c}, 0)" for c in CLARITY_FEATURES}
_ZERO |= {f"freq_{k}": f"coalesce(count_{k} / words, 0)" for k in ("num", "adj", "noun", "conj")}
_ZERO |= {f"freq_{k}": f"coalesce(count_{k} / count_words, 0)" for k in ("color", "brand")}
_ZERO |= {
    "max_words_topic_freq": "CASE WHEN len(nsw) = 0 THEN 0 ELSE coalesce(max_words_topic, 0) / len(nsw) END",
    "title_cat_dup": sql.common(
        "nsw", "list_concat(" + ", ".join(sql.words(f"category_{i}") for i in (1, 2, 3)) + ")"
    ),
    "title_des_dup": sql.common("nsw", "nd"),
}


@query(
    "feat_clarity_frame",
    f"""WITH {TFIDF}, scores AS ({_cosine_sql("tf_score", None)}),
  {TAGGED.replace(sql.PRODUCTS + ",", "")}, {TOPICS}, {sql.VECTORS}, {sql.SIDE_VECTORS},
  {PAIR_MEAN}, {MEAN_VECTOR}, {_LISTED}
SELECT toks.index, {", ".join(f"round(({e})::DOUBLE, 6) AS {c}" for c, e in _ZERO.items())}
FROM toks LEFT JOIN tag_counts USING (index) LEFT JOIN topic_features USING (index)
  LEFT JOIN listed USING (index) LEFT JOIN pair_means USING (index) LEFT JOIN scores USING (index)
  LEFT JOIN mean_cosines USING (index)""",
)
def _(spark, sf_dir):
    return clarity_frame(spark, sf_dir).select(
        "index", *[F.round(c, 6).alias(c) for c in CLARITY_FEATURES]
    )
