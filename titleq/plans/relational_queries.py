"""Projections, filters, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags, text, words
from ..functions.stems import snowball, stems
from ..operators import features, itemsets, layout, lexicon, profile
from ..schemas import CLARITY_FEATURES, COUNT_COLUMNS, SCORE_COLUMNS, SEGMENT_A
from ..session import written
from . import sql
from .catalog import labels, products, scored, table
from .registry import query
from .text_queries import TAGGED, _brands, _part_titles

# Rates into the common currency (fixed values of the examples; other countries count as 1).
RATES = {"NATION_1": 12.5, "NATION_2": 37.25}


@query(
    "flagship_category_profile",
    f"""WITH {sql.CONCISE}, {sql.LABELS}
SELECT category_1, count(*) AS products, count(concise) AS labelled,
  count(*) FILTER (concise = 1) AS concise_products, count(*) FILTER (clarity = 1) AS clear_products,
  round(avg(original_tokens), 6) AS original_tokens, round(avg(nsw_tokens), 6) AS nsw_tokens,
  round(avg(sw_tokens), 6) AS sw_tokens, round(avg(regex_tokens), 6) AS regex_tokens,
  round(avg(tit_des_ratio), 6) AS tit_des_ratio, round(avg(des_same), 6) AS des_same,
  round(avg(repeat_tokens), 6) AS repeat_tokens,
  round(avg(title_character_count), 6) AS title_character_count
FROM concise_features LEFT JOIN lab USING (index) GROUP BY category_1""",
)
def _(spark, sf_dir):
    rows = features.concise_features(products(spark, sf_dir)).drop("title", "description")
    means = (
        "original_tokens", "nsw_tokens", "sw_tokens", "regex_tokens", "tit_des_ratio", "des_same",
        "repeat_tokens", "title_character_count",
    )
    return (
        rows.join(labels(spark, sf_dir), "index", "left")
        .groupBy("category_1")
        .agg(
            F.count("*").alias("products"),
            F.count("concise").alias("labelled"),
            F.count_if(F.col("concise") == 1).alias("concise_products"),
            F.count_if(F.col("clarity") == 1).alias("clear_products"),
            *[F.round(F.avg(c), 6).alias(c) for c in means],
        )
    )


# ---- projections and filters --------------------------------------------------------------------


@query(
    "prj_select",
    f"""WITH {sql.PRODUCTS} SELECT index, title AS new_title, category_1, n_chars * 2 AS doubled
FROM products""",
)
def _(spark, sf_dir):
    return (
        products(spark, sf_dir, False)
        .withColumn("doubled", F.col("n_chars") * 2)
        .drop("description", "category_2", "category_3")
        .select("index", F.col("title").alias("new_title"), "category_1", "doubled")
    )


@query(
    "prj_row_index",
    "SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS index FROM labels",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return layout.row_index(rows, "doc_id").select("doc_id", "quality", "index")


@query(
    "prj_na_fill",
    f"""WITH {sql.CONCISE} SELECT p.index, coalesce(description, '') AS description,
  coalesce(CASE WHEN des_tokens > 0 THEN nsw_tokens::DOUBLE / des_tokens END, 1) AS tit_des_ratio
FROM products p JOIN concise_features f ON f.index = p.index""",
)
def _(spark, sf_dir):
    df = features.concise_features(products(spark, sf_dir)).withColumn(
        "tit_des_ratio", F.try_divide(F.col("nsw_tokens"), F.col("des_tokens"))
    )
    return df.na.fill({"description": "", "tit_des_ratio": 1.0}).select(
        "index", "description", "tit_des_ratio"
    )


@query(
    "flt_category",
    f"WITH {sql.PRODUCTS} SELECT index, title FROM products WHERE category_1 = 'Fashion'",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False)
    return df.where(F.col("category_1") == "Fashion").select("index", "title")


@query("flt_segment", f"WITH {sql.PRODUCTS} SELECT index, category_1, {sql.SEG_A} AS seg_a FROM products")
def _(spark, sf_dir):
    return products(spark, sf_dir, False).select(
        "index", "category_1", features.in_segment_a().alias("seg_a")
    )


@query(
    "flt_conjunction",
    f"WITH {sql.SCORED} SELECT index, label, prediction FROM scored WHERE label = 0 AND prediction = 0",
)
def _(spark, sf_dir):
    return (
        scored(spark, sf_dir)
        .filter("label == 0")
        .filter("prediction == 0")
        .select("index", "label", "prediction")
    )


@query(
    "arr_compact",
    f"""WITH {TAGGED}
SELECT p.index, coalesce(n, 0) AS n, coalesce(kept, '') AS kept FROM products p LEFT JOIN (
  SELECT index, count(*) AS n, string_agg(token, ' ' ORDER BY place) AS kept FROM tagged
  WHERE tag <> 'PUNCT' GROUP BY index) t ON t.index = p.index""",
)
def _(spark, sf_dir):
    raw = F.transform(
        tags.raw_tokens(F.col("title")), lambda t: F.when(tags.tag(t) != "PUNCT", t)
    )
    df = products(spark, sf_dir).select("index", F.array_compact(raw).alias("kept"))
    return df.select(
        "index", F.size("kept").cast("long").alias("n"), F.array_join("kept", " ").alias("kept")
    )


@query(
    "prj_feature_subset",
    f"""WITH {TAGGED} SELECT p.index, """
    + ", ".join(f"coalesce(count_{k} / words, 0.0) AS freq_{k}" for k in ("num", "adj", "noun", "conj"))
    + " FROM products p LEFT JOIN tag_counts t ON t.index = p.index",
)
def _(spark, sf_dir):
    rows = features.tag_counts(products(spark, sf_dir))
    dropped = [c for c in COUNT_COLUMNS + SCORE_COLUMNS if c in rows.columns]
    rows = rows.drop(*dropped)
    return rows.select("index", *[c for c in CLARITY_FEATURES if c in rows.columns])


@query(
    "prj_explode",
    f"WITH {sql.PRODUCTS} SELECT index, unnest({sql.words('title')}) AS token FROM products",
)
def _(spark, sf_dir):
    return products(spark, sf_dir).select(
        "index", F.explode(text.words(F.col("title"))).alias("token")
    )


@query(
    "prj_cast_int",
    f"""WITH {sql.PRODUCTS} SELECT index, CAST(regexp_extract(category_2, '[0-9]+') AS INTEGER) AS number,
  TRY_CAST(split_part(title, ' ', 1) AS INTEGER) AS first_number FROM products""",
)
def _(spark, sf_dir):
    return products(spark, sf_dir, False).select(
        "index",
        F.regexp_extract("category_2", "([0-9]+)", 1).cast("int").alias("number"),
        F.split_part("title", F.lit(" "), F.lit(1)).try_cast("int").alias("first_number"),
    )


@query(
    "prj_currency",
    f"""SELECT o_orderkey, n_name, o_totalprice AS org_price, o_totalprice * CASE n_name {" ".join(
        f"WHEN '{n}' THEN {r}::DOUBLE" for n, r in RATES.items())} ELSE 1.0 END AS price
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    where = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(where, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "n_name",
        F.col("o_totalprice").alias("org_price"),
        features.price_in(F.col("o_totalprice"), F.col("n_name"), RATES).alias("price"),
    )


# ---- joins --------------------------------------------------------------------------------------


@query(
    "join_labels",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS}
SELECT index, category_1, concise, clarity FROM products JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    both = labels(spark, sf_dir)
    label = both.select("index", "concise").join(both.select("index", "clarity"), "index")
    rows = products(spark, sf_dir, False).select("index", "category_1")
    return rows.join(label, "index")


@query(
    "join_inner_using",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS}
SELECT index, category_1, category_2, category_3, title AS new_title, clarity AS label
FROM products JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False)
    raw = df.select("index", "category_1", "category_2", "category_3")
    whole = df.select("index", F.col("title").alias("new_title")).join(
        labels(spark, sf_dir).select("index", F.col("clarity").alias("label")), "index"
    )
    return raw.join(whole.select("index", "new_title", "label"), "index", "inner")


@query(
    "join_array_equality",
    f"""WITH {sql.PRODUCTS} SELECT index, category_1, CASE category_1 WHEN 'Fashion' THEN 'fashion'
  ELSE 'watch, sunglass, jewelleri' END AS cat
FROM products WHERE category_1 IN ({sql.quoted(SEGMENT_A)})""",
)
def _(spark, sf_dir):
    literal = spark.createDataFrame(
        [("fashion",), ("watch, sunglass, jewelleri",)], "cat string"
    ).withColumn("cat_new", F.split("cat", ", "))
    rows = products(spark, sf_dir, False).select("index", "category_1")
    # Each category is stemmed once, not once for each of its products.
    names = rows.select("category_1").distinct().withColumn(
        "cat_1_stem", stems(text.words(F.col("category_1")), snowball)
    )
    # Two literal rows: a broadcast of fixed size.
    found = names.join(F.broadcast(literal), F.col("cat_1_stem") == F.col("cat_new"))
    return rows.join(found.select("category_1", "cat"), "category_1").select("index", "category_1", "cat")


@query(
    "join_frequent_groups",
    f"""WITH {sql.PRODUCTS}, g AS (SELECT category_2, category_3 FROM products GROUP BY ALL HAVING count(*) > 5)
SELECT index, category_2, category_3 FROM products SEMI JOIN g USING (category_2, category_3)""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False).select("index", "category_2", "category_3")
    main = df.groupBy("category_2", "category_3").count().where("count > 5")
    # Stored, the groups have a known size: the planner broadcasts them only if they are small.
    main = written(main, "main_groups")
    return df.join(main, ["category_2", "category_3"], "left_semi").select(
        "index", "category_2", "category_3"
    )


@query(
    "join_feature_frames",
    f"""WITH {sql.CONCISE}, {TAGGED.replace(sql.PRODUCTS + ",", "")}
SELECT f.index, nsw_tokens, des_same, coalesce(count_num, 0) AS count_num,
  coalesce(count_noun, 0) AS count_noun FROM concise_features f LEFT JOIN tag_counts t ON t.index = f.index""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir)
    counts = features.tag_counts(df).select("index", "count_num", "count_noun")
    scores = features.concise_features(df).select("index", "nsw_tokens", "des_same")
    joined = scores.join(counts, "index")
    return joined.select(
        "index", *[F.col(c).cast("long").alias(c) for c in joined.columns if c != "index"]
    )


@query(
    "join_lexicon",
    """WITH brands AS (SELECT DISTINCT lower(p_brand) AS token FROM part),
  t AS (SELECT p_partkey AS index, unnest(string_split(lower(p_name || ' ' || p_brand), ' ')) AS token
    FROM part)
SELECT index, token, count(*) AS n FROM t JOIN brands USING (token) GROUP BY index, token""",
)
def _(spark, sf_dir):
    tokens = _part_titles(spark, sf_dir).select("index", F.explode("tokens").alias("token"))
    found = layout.split_lookup(tokens, _brands(spark, sf_dir), "token")
    return found.groupBy("index", "token").agg(F.count("*").alias("n"))


@query(
    "join_shared_errors",
    f"""WITH {sql.SCORED}, rule2 AS (
  SELECT index, CASE WHEN length(title) > 40 THEN 1 ELSE 0 END AS prediction FROM products)
SELECT s.index FROM scored s JOIN rule2 r ON r.index = s.index
WHERE label = 0 AND s.prediction = 1 AND r.prediction = 1""",
)
def _(spark, sf_dir):
    first = scored(spark, sf_dir)
    rule = (F.length("title") > 40).cast("int").alias("prediction")
    second = (
        products(spark, sf_dir, False).select("index", rule)
        .join(first.select("index", "label"), "index")
    )
    wrong = "label == 0 and prediction == 1"
    return first.filter(wrong).select("index").join(second.filter(wrong).select("index"), "index")


# ---- aggregations -------------------------------------------------------------------------------

_COLUMNS = ("category_1", "category_2", "category_3", "concise")


def _value_counts(spark, sf_dir):
    """(name, value, n) for several columns from one pass over the rows."""
    df = products(spark, sf_dir, False).join(labels(spark, sf_dir), "index", "left")
    return profile.value_counts(df, _COLUMNS)


_COUNTED = f"""WITH {sql.PRODUCTS}, {sql.LABELS}, j AS (SELECT * FROM products LEFT JOIN lab USING (index)),
  c AS ({" UNION ALL ".join(
      f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM j GROUP BY {c}"
      for c in _COLUMNS)})"""


@query("agg_value_counts", f"{_COUNTED} SELECT * FROM c")
def _(spark, sf_dir):
    return _value_counts(spark, sf_dir).orderBy("name", F.desc("n"), "value")


@query("agg_value_counts_nonnull", f"{_COUNTED} SELECT * FROM c WHERE value IS NOT NULL")
def _(spark, sf_dir):
    counts = _value_counts(spark, sf_dir).dropna(subset=["value"])
    return counts.orderBy("name", F.desc("n"), "value")


@query(
    "agg_having",
    f"""WITH {sql.PRODUCTS} SELECT category_2, category_3, count(*) AS n FROM products
GROUP BY ALL HAVING count(*) > 5""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False)
    return df.groupBy("category_2", "category_3").agg(F.count("*").alias("n")).where("n > 5")


@query(
    "agg_label_counts",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS}
SELECT category_1, count(*) FILTER (clarity = 1) AS clear, count(*) FILTER (clarity = 0) AS unclear,
  count(*) FILTER (concise = 1) AS concise, count(*) FILTER (concise = 0) AS wordy
FROM products JOIN lab USING (index) GROUP BY category_1""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False).join(labels(spark, sf_dir), "index")
    return df.groupBy("category_1").agg(
        F.count_if(F.col("clarity") == 1).alias("clear"),
        F.count_if(F.col("clarity") == 0).alias("unclear"),
        F.count_if(F.col("concise") == 1).alias("concise"),
        F.count_if(F.col("concise") == 0).alias("wordy"),
    )


@query(
    "agg_count_if",
    f"""WITH {sql.CONCISE}, {sql.LABELS} SELECT count(*) FILTER (des_same > 0 AND clarity = 1) AS n
FROM concise_features JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    df = features.concise_features(products(spark, sf_dir)).select("index", "des_same")
    joined = df.join(labels(spark, sf_dir), "index")
    return joined.agg(F.count_if((F.col("des_same") > 0) & (F.col("clarity") == 1)).alias("n"))


@query(
    "agg_class_distribution",
    f"""WITH {sql.LABELS} SELECT 'concise' AS name, concise AS label, count(*) AS n FROM lab GROUP BY concise
UNION ALL SELECT 'clarity', clarity, count(*) FROM lab GROUP BY clarity""",
)
def _(spark, sf_dir):
    counts = profile.value_counts(labels(spark, sf_dir), ("concise", "clarity"))
    return counts.select("name", F.col("value").cast("int").alias("label"), "n")


@query(
    "agg_null_profile",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS}, j AS (SELECT *,
    CASE WHEN description IS NULL THEN 'NaN'::DOUBLE ELSE n_chars END AS size
  FROM products LEFT JOIN lab USING (index))
SELECT count(*) AS n, count(title) AS title, count(description) AS description,
  count(category_1) AS category_1, count(concise) AS concise, count(clarity) AS clarity,
  count(size) FILTER (NOT isnan(size)) AS size FROM j""",
)
def _(spark, sf_dir):
    size = F.when(F.col("description").isNull(), F.lit(float("nan"))).otherwise(F.col("n_chars"))
    rows = products(spark, sf_dir, False).withColumn("size", size.cast("double"))
    # Texts shrink to flags before the join.
    flags = profile.present(rows, ["title", "description", "category_1", "size"], ["index"])
    given = profile.present(labels(spark, sf_dir), ["concise", "clarity"], ["index"])
    joined = flags.join(given, "index", "left").drop("index")
    return joined.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in joined.columns])


@query(
    "agg_distinct",
    f"""WITH {TAGGED} SELECT DISTINCT 'category_1' AS kind, category_1 AS value FROM products
UNION ALL SELECT DISTINCT 'tag', tag FROM tagged""",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir)
    kinds = df.select(F.lit("category_1").alias("kind"), F.col("category_1").alias("value"))
    tag = F.explode(tags.tagged(F.col("title"))["tag"])
    return kinds.distinct().unionByName(
        df.select(F.lit("tag").alias("kind"), tag.alias("value")).distinct()
    )


@query(
    "agg_describe",
    f"""WITH {sql.PRODUCTS}, v AS (
  SELECT 'n_chars' AS name, n_chars::DOUBLE AS x FROM products
  UNION ALL SELECT 'title_length', length(title) FROM products
  UNION ALL SELECT 'description_length', length(description) FROM products)
SELECT name, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev,
  min(x) AS min, max(x) AS max FROM v GROUP BY name""",
)
def _(spark, sf_dir):
    named = {
        "n_chars": F.col("n_chars"),
        "title_length": F.length("title"),
        "description_length": F.length("description"),
    }
    out = profile.describe(products(spark, sf_dir, False), named)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query(
    "agg_corr",
    f"""WITH {sql.SCORED} SELECT (SELECT round(corr(concise, clarity), 9) FROM lab) AS label_label,
  (SELECT round(corr(score, label), 9) FROM scored) AS score_label""",
)
def _(spark, sf_dir):
    both = scored(spark, sf_dir).join(labels(spark, sf_dir), "index")
    return both.agg(
        F.round(F.corr("concise", "clarity"), 9).alias("label_label"),
        F.round(F.corr("score", "label"), 9).alias("score_label"),
    )


_Z = ("title_character_count", "nsw_tokens", "des_tokens")


@query(
    "agg_zscore",
    f"""WITH {sql.CONCISE}, s AS (SELECT {", ".join(
        f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _Z)} FROM concise_features)
SELECT index, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _Z)} FROM concise_features, s""",
)
def _(spark, sf_dir):
    rows = features.concise_features(products(spark, sf_dir)).select("index", *_Z)
    return profile.zscore(rows, _Z).select("index", *[F.round(c, 6).alias(c) for c in _Z])


# ---- sorts and sets -----------------------------------------------------------------------------


@query(
    "srt_topk",
    f"WITH {sql.PRODUCTS} SELECT index, title, category_1 FROM products ORDER BY index LIMIT 20",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False).select("index", "title", "category_1")
    return df.orderBy("index").limit(20)


@query("srt_cast", "SELECT CAST(doc_id + 1 AS BIGINT) AS index_int, quality FROM labels")
def _(spark, sf_dir):
    texts = labels(spark, sf_dir).select(
        F.col("index").cast("string").alias("index"), F.col("concise").alias("quality")
    )
    return texts.withColumn("index_int", F.col("index").cast("long")).orderBy("index_int").drop("index")


@query(
    "set_except",
    f"WITH {sql.PRODUCTS} SELECT index, category_1 FROM products WHERE NOT {sql.SEG_A}",
)
def _(spark, sf_dir):
    df = products(spark, sf_dir, False).select("index", "category_1")
    segment = df.where(features.in_segment_a())
    # index is unique, so the set difference is an anti join on it.
    return df.join(segment, "index", "left_anti")


@query("set_union_all", f"WITH {sql.PRODUCTS} SELECT index, category_1, {sql.SEG_A} AS seg_a FROM products")
def _(spark, sf_dir):
    df = products(spark, sf_dir, False).select(
        "index", "category_1", features.in_segment_a().alias("seg_a")
    )
    return df.where("seg_a").unionByName(df.where("not seg_a"))


@query(
    "set_union_distinct",
    """SELECT lower(p_brand) AS token FROM part UNION
SELECT unnest(string_split(lower(p_name), ' ')) FROM part""",
)
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(
        F.explode(F.split(F.lower("p_name"), " ")).alias("token")
    )
    return lexicon.lexicon_union(_brands(spark, sf_dir), names)


# ---- frequent word sets -------------------------------------------------------------------------


def _itemset_sql(rows: str, prefix: str, levels: int = 4) -> str:
    """CTEs ``{prefix}sets(items, freq)``: level-wise search over table ``rows(index, items)``."""
    p = prefix
    parts = [
        f"{p}need AS (SELECT ceil(0.1 * count(*)) AS n FROM {rows})",
        f"{p}occ AS (SELECT DISTINCT index, unnest(items) AS item FROM {rows})",
        f"{p}l1 AS (SELECT [item] AS items, count(*) AS freq FROM {p}occ GROUP BY item "
        f"HAVING count(*) >= (SELECT n FROM {p}need))",
        f"{p}o AS (SELECT * FROM {p}occ WHERE [item] IN (SELECT items FROM {p}l1))",
        f"{p}t1 AS (SELECT index, [item] AS items FROM {p}o)",
    ]
    for k in range(2, levels + 1):
        parts.append(
            f"{p}t{k}a AS (SELECT t.index, list_append(t.items, o.item) AS items FROM {p}t{k - 1} t "
            f"JOIN {p}o o ON o.index = t.index AND o.item > t.items[-1])"
        )
        parts.append(
            f"{p}l{k} AS (SELECT items, count(*) AS freq FROM {p}t{k}a GROUP BY items "
            f"HAVING count(*) >= (SELECT n FROM {p}need))"
        )
        parts.append(f"{p}t{k} AS (SELECT * FROM {p}t{k}a WHERE items IN (SELECT items FROM {p}l{k}))")
    union = " UNION ALL ".join(f"SELECT * FROM {p}l{k}" for k in range(1, levels + 1))
    return ", ".join(parts) + f", {p}sets AS ({union})"


def _titles(spark, sf_dir):
    return products(spark, sf_dir).select("index", text.useful_words(F.col("title")).alias("tokens"))


_TITLE_ITEMS = f"{sql.TOKENS}, titles AS (SELECT index, nsw AS items FROM toks)"


@query(
    "ml_fpgrowth",
    f"""WITH {_TITLE_ITEMS}, {_itemset_sql("titles", "a")}
SELECT len(items) AS size, {sql.joined("items")} AS items, freq FROM asets""",
)
def _(spark, sf_dir):
    sets = itemsets.itemsets(itemsets.fit(_titles(spark, sf_dir), "tokens"))
    return sets.select(
        F.size("items").cast("long").alias("size"), F.array_join("items", " ").alias("items"), "freq"
    )


@query(
    "agg_itemset_pairs",
    f"""WITH {_TITLE_ITEMS}, {_itemset_sql("titles", "a", 2)}
SELECT {sql.joined("items")} AS items, freq FROM asets WHERE len(items) = 2""",
)
def _(spark, sf_dir):
    sets = itemsets.itemsets(itemsets.fit(_titles(spark, sf_dir), "tokens"))
    return sets.where(F.size("items") == 2).select(F.array_join("items", " ").alias("items"), "freq")


@query(
    "join_common_itemsets",
    f"""WITH {_TITLE_ITEMS}, {sql.LABELS},
  yes AS (SELECT * FROM titles SEMI JOIN (SELECT index FROM lab WHERE concise = 1) l USING (index)),
  no AS (SELECT * FROM titles SEMI JOIN (SELECT index FROM lab WHERE concise = 0) l USING (index)),
  {_itemset_sql("yes", "yes_")}, {_itemset_sql("no", "no_")}
SELECT {sql.joined("items")} AS items, y.freq AS freq_true, n.freq AS freq_false
FROM yes_sets y JOIN no_sets n USING (items)""",
)
def _(spark, sf_dir):
    rows = _titles(spark, sf_dir).join(labels(spark, sf_dir), "index")
    sets = [
        itemsets.itemsets(itemsets.fit(rows.where(F.col("concise") == k), "tokens"))
        for k in (1, 0)
    ]
    both = sets[0].withColumnRenamed("freq", "freq_true").join(
        sets[1].withColumnRenamed("freq", "freq_false"), "items"
    )
    return both.select(F.array_join("items", " ").alias("items"), "freq_true", "freq_false")


@query(
    "ml_itemsets_vertical",
    f"""WITH {_TITLE_ITEMS}, {_itemset_sql("titles", "a", 8)}
SELECT len(items) AS size, {sql.joined("items")} AS items, freq FROM asets""",
)
def _(spark, sf_dir):
    """Frequent word sets by intersecting bitsets, level by level."""
    sets = itemsets.vertical(written(_titles(spark, sf_dir), "titles"), "tokens")
    return sets.select(
        F.size("items").cast("long").alias("size"), F.array_join("items", " ").alias("items"), "freq"
    )


_RULES_SQL = f"""WITH {_TITLE_ITEMS}, {_itemset_sql("titles", "a", 8)},
  total AS (SELECT count(*) AS total FROM titles),
  parts AS (SELECT list_filter(items, lambda x: x <> c) AS antecedent, c AS consequent, freq
    FROM (SELECT items, freq, unnest(items) AS c FROM asets WHERE len(items) > 1))
SELECT {sql.joined("antecedent")} AS antecedent, consequent, round(p.freq / a.freq, 9) AS confidence,
  round((p.freq / a.freq) / (b.freq / total), 9) AS lift, round(p.freq / total, 9) AS support
FROM parts p JOIN asets a ON a.items = antecedent JOIN asets b ON b.items = [consequent], total
WHERE p.freq / a.freq >= 0.5"""


@query("ml_rules_vertical", _RULES_SQL)
def _(spark, sf_dir):
    """Rules with one consequent from the sets found by bitsets."""
    titles = written(_titles(spark, sf_dir), "titles")
    found = itemsets.rules(itemsets.vertical(titles, "tokens"), titles.count())
    return found.select(
        F.array_join("antecedent", " ").alias("antecedent"), "consequent",
        *[F.round(c, 9).alias(c) for c in ("confidence", "lift", "support")],
    )


@query("ml_association_rules", _RULES_SQL.replace("round((p.freq / a.freq) / (b.freq / total), 9) AS lift, ", ""))
def _(spark, sf_dir):
    rules = itemsets.fit(_titles(spark, sf_dir), "tokens").associationRules
    return rules.select(
        F.array_join(F.array_sort("antecedent"), " ").alias("antecedent"),
        F.array_join("consequent", " ").alias("consequent"),
        F.round("confidence", 9).alias("confidence"),
        F.round("support", 9).alias("support"),
    )
