"""File formats: each query writes rows of the given tables, reads them back and returns them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import html, tags, text
from ..models import training
from ..operators import features
from ..schemas import (
    CLEAN_PRODUCT,
    PROCESSED_PRODUCT,
    RAW_PRODUCT,
    SEGMENT_A,
)
from ..session import scratch_path
from ..sources import readers, writers
from . import sql
from .catalog import labels, products, table, word_vectors
from .registry import query
from .text_queries import TAGGED, _bare_sql


def _raw_products(spark, sf_dir):
    """Products in the shape of the raw catalogue file."""
    return products(spark, sf_dir, False).select(
        F.col("category_3").alias("country"),
        F.concat(F.lit("SKU"), F.col("index").cast("string")).alias("sku_id"),
        "title",
        "category_1",
        "category_2",
        "category_3",
        "description",
        (F.col("n_chars") / 2).cast("float").alias("org_price"),
        F.lit("local").alias("product_type"),
    )


_RAW_SQL = f"""WITH {sql.PRODUCTS} SELECT category_3 AS country, 'SKU' || index AS sku_id,
  title, category_1, category_2, category_3, description, n_chars / 2.0::DOUBLE AS org_price,
  'local' AS product_type FROM products"""


@query("src_csv_typed", _RAW_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "raw.csv")
    writers.write_csv(_raw_products(spark, sf_dir), path, header=False)
    return readers.read_csv(spark, path, RAW_PRODUCT).withColumn(
        "org_price", F.col("org_price").cast("double")
    )


def _processed(spark, sf_dir):
    clean = text.strip_special
    return (
        products(spark, sf_dir, False)
        .join(labels(spark, sf_dir), "index")
        .select(
            "index",
            "title",
            clean(F.col("title")).alias("new_title"),
            "description",
            clean(F.col("description")).alias("new_des"),
            "category_1",
            "concise",
            "clarity",
        )
    )


def _cleaned_sql(c):
    return f"regexp_replace({c}, '[''\"</&\\[+>()\\-]', ' ', 'g')"


@query(
    "src_csv_header_typed",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS} SELECT index,
  title, {_cleaned_sql("title")} AS new_title, description, {_cleaned_sql("description")} AS new_des, category_1, concise, clarity
FROM products JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "processed.csv")
    writers.write_csv(_processed(spark, sf_dir), path, header=True)
    return readers.read_csv(spark, path, PROCESSED_PRODUCT, header=True)


@query(
    "src_csv_header_strings",
    f"""WITH {sql.PRODUCTS} SELECT index, title, category_1, n_chars FROM products""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "clean.csv")
    rows = products(spark, sf_dir, False).select(
        "index", "title", "category_1", "n_chars"
    )
    writers.write_csv(rows, path, header=True)
    types = {"index": "long", "title": "string", "category_1": "string", "n_chars": "long"}
    return readers.read_csv_strings(spark, path, types)


@query(
    "src_label_files",
    """SELECT row_number() OVER (ORDER BY doc_id) AS index, quality AS concise, 1 - toxic AS clarity
FROM labels""",
)
def _(spark, sf_dir):
    rows = labels(spark, sf_dir)
    files = {}
    for name in ("concise", "clarity"):
        files[name] = scratch_path(spark, f"{name}.labels")
        writers.write_lines(rows, F.col(name).cast("string"), "index", files[name])
    concise, clarity = (readers.read_label_file(spark, p, n) for n, p in files.items())
    return concise.join(clarity, "index")


@query(
    "src_jsonl",
    f"""WITH {sql.TOKENS} SELECT index, {sql.joined("nsw")} AS title_words, len(nd) AS n_des,
  {sql.common("nsw", "nd")} AS result FROM toks""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "words.json")
    lists = features.word_lists(products(spark, sf_dir))
    rows = lists.select(
        "index",
        F.col("title_words").alias("new_title_stem"),
        F.col("desc_words").alias("new_des_stem"),
        features.overlap(F.col("title_words"), F.col("desc_words")).alias("result"),
    )
    writers.write_json(rows, path)
    schema = "index long, new_title_stem array<string>, new_des_stem array<string>, result int"
    return readers.read_json(spark, path, schema).select(
        "index",
        F.array_join("new_title_stem", " ").alias("title_words"),
        F.size("new_des_stem").cast("long").alias("n_des"),
        F.col("result").cast("long").alias("result"),
    )


@query(
    "src_parquet",
    f"""WITH {TAGGED} SELECT index, place, tag, token AS text FROM tagged""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "tagged.parquet")
    rows = products(spark, sf_dir).select("index", tags.tagged(F.col("title")).alias("tagged"))
    writers.write_parquet(rows, path)
    schema = "index long, tagged array<struct<tag:string,text:string>>"
    return readers.read_parquet(spark, path, schema).select(
        "index", F.posexplode("tagged").alias("place", "t")
    ).select("index", (F.col("place") + 1).cast("long").alias("place"), "t.tag", "t.text")


_VECTOR_ROWS = """SELECT row_number() OVER (ORDER BY vec_id) AS index, embedding FROM embeddings"""


@query(
    "src_vector_text",
    f"""WITH r AS ({_VECTOR_ROWS}), c AS (
  SELECT index, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM r)
SELECT index, pos, x::VARCHAR::DOUBLE AS value FROM c""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "vectors.txt")
    writers.write_vector_text(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", path)
    return readers.read_vector_text(spark, path).select(
        "index", F.posexplode("vec").alias("pos", "value")
    ).select("index", F.col("pos").cast("long").alias("pos"), "value")


@query(
    "src_lexicon",
    "SELECT DISTINCT lower(p_brand) || ' ' || chr(233) || lower(p_type) AS token FROM part",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "lexicon.txt")
    entry = F.concat(F.lower("p_brand"), F.lit(" é"), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), entry, F.lit(" ")).alias("t"))
    (
        rows.write.option("encoding", "ISO-8859-1")
        .option("sep", "\t")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return readers.read_lexicon(spark, path)


@query(
    "src_embedding_table",
    f"""WITH {sql.TOKENS}, {sql.VECTORS}, words AS (SELECT DISTINCT unnest(nsw) AS token FROM toks),
  ids AS (SELECT token, {sql.vec_id("token")} AS vec_id FROM words)
SELECT token, vec_id, len(vec) AS dim, round(vec[1], 6) AS first, round(vec[len(vec)], 6) AS last
FROM ids JOIN unit USING (vec_id)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "word_vectors.parquet")
    words = products(spark, sf_dir).select(
        F.explode(text.useful_words(F.col("title"))).alias("token")
    ).distinct()
    writers.write_parquet(word_vectors(spark, sf_dir).attach(words, "vec"), path)
    stored = readers.read_parquet(spark, path, "token string, vec_id long, vec array<double>")
    return stored.select(
        "token",
        "vec_id",
        F.size("vec").cast("long").alias("dim"),
        F.round(F.element_at("vec", 1), 6).alias("first"),
        F.round(F.element_at("vec", -1), 6).alias("last"),
    )


_SVM_COLUMNS = ("original_tokens", "nsw_tokens", "des_same", "repeat_tokens")


@query(
    "src_libsvm",
    f"""WITH {sql.CONCISE}, {sql.LABELS} SELECT concise::DOUBLE AS label, {", ".join(
        f"{c}::DOUBLE AS {c}" for c in _SVM_COLUMNS)} FROM concise_features JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "features.libsvm")
    rows = features.concise_features(products(spark, sf_dir)).join(labels(spark, sf_dir), "index")
    vectors = training.assembled(rows, _SVM_COLUMNS, "concise").select("label", "features")
    vectors.write.format("libsvm").save(path)
    back = (
        spark.read.format("libsvm").option("numFeatures", str(len(_SVM_COLUMNS))).load(path)
        .select("label", vector_to_array("features").alias("v"))
    )
    return back.select("label", *[F.col("v")[i].alias(c) for i, c in enumerate(_SVM_COLUMNS)])


@query(
    "src_literal",
    f"""WITH {sql.PRODUCTS}
SELECT CASE category_1 WHEN 'Fashion' THEN 'fashion' ELSE 'watches' END AS segment, count(*) AS n
FROM products WHERE category_1 IN ({sql.quoted(SEGMENT_A)}) GROUP BY ALL""",
)
def _(spark, sf_dir):
    literal = spark.createDataFrame(
        list(zip(SEGMENT_A, ("fashion", "watches"))), "category_1 string, segment string"
    )
    # Two literal rows: a broadcast of fixed size.
    rows = products(spark, sf_dir, False).join(F.broadcast(literal), "category_1")
    return rows.groupBy("segment").agg(F.count("*").alias("n"))


@query(
    "prep_catalogue",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS}, j AS (
  SELECT row_number() OVER (ORDER BY index) AS index, title, description, category_1, category_2,
    category_3, concise, clarity FROM products JOIN lab USING (index))
SELECT index, title, category_1, category_2, category_3, {_bare_sql("description")} AS description, concise, clarity FROM j""",
)
def _(spark, sf_dir):
    """Raw headerless products and two keyless label files to the clean frame.

    Rows of the three files belong together by their position.
    """
    given = labels(spark, sf_dir)
    raw = _raw_products(spark, sf_dir).withColumn(
        "index", F.substring("sku_id", 4, 20).cast("long")
    ).join(given, "index")
    raw = raw.repartitionByRange("index").sortWithinPartitions("index")
    files = {n: scratch_path(spark, n) for n in ("raw.csv", "concise", "clarity", "clean.csv")}
    columns = [c.split()[0] for c in RAW_PRODUCT.split(", ")]
    writers.write_csv(raw.select(*columns), files["raw.csv"], header=False)
    for name in ("concise", "clarity"):
        writers.write_lines(given, F.col(name).cast("string"), "index", files[name])

    rows = readers.numbered(readers.read_csv(spark, files["raw.csv"], RAW_PRODUCT))
    label = readers.read_label_file(spark, files["concise"], "concise").join(
        readers.read_label_file(spark, files["clarity"], "clarity"), "index"
    )
    clean = rows.withColumn("description", html.html_to_text(F.col("description")))
    clean = clean.join(label, "index").select(
        "index", "title", "category_1", "category_2", "category_3", "description", "concise", "clarity"
    )
    writers.write_csv(clean, files["clean.csv"], header=True, sort="index")
    return readers.read_csv(spark, files["clean.csv"], CLEAN_PRODUCT, header=True)


# ---- sinks --------------------------------------------------------------------------------------


@query(
    "snk_csv",
    f"""WITH {sql.PRODUCTS}, {sql.LABELS} SELECT index, title, category_1, category_2, category_3, description,
  concise, clarity FROM products LEFT JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "clean_frame.csv")
    rows = products(spark, sf_dir, False).join(labels(spark, sf_dir), "index", "left").select(
        "index",
        "title",
        "category_1",
        "category_2",
        "category_3",
        "description",
        "concise",
        "clarity",
    )
    writers.write_csv(rows, path, header=True, sort="index")
    return readers.read_csv(spark, path, CLEAN_PRODUCT, header=True)


@query(
    "snk_json",
    f"WITH {sql.PRODUCTS} SELECT index, title, description, category_1 FROM products",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "frame.json")
    rows = products(spark, sf_dir, False).select("index", "title", "description", "category_1")
    writers.write_json(rows, path)
    return readers.read_json(
        spark, path, "index long, title string, description string, category_1 string"
    )


@query(
    "snk_vector_text",
    f"""WITH r AS ({_VECTOR_ROWS})
SELECT index, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM r""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "vectors.txt")
    writers.write_vector_text(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return readers.read_vector_text(spark, path).select(
        "index", F.size("vec").cast("long").alias("dim"), F.round(total, 4).alias("total")
    )


@query(
    "snk_parquet",
    f"""WITH {sql.CONCISE} SELECT index, original_tokens, nsw_tokens, des_same, tit_des_ratio
FROM concise_features""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "features.parquet")
    rows = features.concise_features(products(spark, sf_dir)).select(
        "index",
        *[F.col(c).cast("long").alias(c) for c in ("original_tokens", "nsw_tokens", "des_same")],
        "tit_des_ratio",
    )
    writers.write_parquet(rows, path)
    return readers.read_parquet(
        spark, path,
        "index long, original_tokens long, nsw_tokens long, des_same long, tit_des_ratio double",
    )


@query("snk_model")
def _(spark, sf_dir):
    """Predictions of a model that was saved and loaded again."""
    path = scratch_path(spark, "model")
    rows = training.concise_frame(products(spark, sf_dir), labels(spark, sf_dir))
    LogisticRegression(maxIter=10).fit(rows).write().overwrite().save(path)
    scored = LogisticRegressionModel.load(path).transform(rows)
    return training.predictions(scored)
