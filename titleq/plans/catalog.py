"""The given tables seen as a product catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread
from ..operators.similarity import WordVectors
from ..schemas import CATEGORIES, TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def category(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)", 1).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), number % len(CATEGORIES) + 1)


def products(spark: SparkSession, sf_dir: str, spread_rows: bool = True) -> DataFrame:
    """One product per document: first line = title, the rest = description, both in full.

    Labels are joined later, on index, so that texts never travel through that join.
    """
    docs = table(spark, sf_dir, "documents")
    if spread_rows:
        docs = spread(docs, "doc_id")
    line = F.instr("text", "\n")
    return docs.select(
        (F.col("doc_id") + 1).alias("index"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(line > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).alias("description"),
        category(F.col("source")).alias("category_1"),
        F.col("source").alias("category_2"),
        F.col("lang").alias("category_3"),
        "n_chars",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, concise, clarity)"""
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 1).alias("index"),
        F.col("quality").alias("concise"),
        (1 - F.col("toxic")).alias("clarity"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled products with a score by rule: long texts score high."""
    docs = products(spark, sf_dir, spread_rows=False).select("index", "category_1", "n_chars")
    score = F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000, 3))
    return (
        docs.join(labels(spark, sf_dir), "index")
        .select("index", "category_1", F.col("concise").alias("label"), score.alias("score"))
        .withColumn("prediction", (F.col("score") > 0.1).cast("int"))
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> WordVectors:
    """The embeddings table as word vectors: a word's vector number comes from its hash.

    The hash reaches a tenth beyond the table, so some words have no vector.
    """
    stored = table(spark, sf_dir, "embeddings")
    rows = stored.count()
    dim = stored.select(F.size("embedding")).first()[0]
    code = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    vecs = stored.select("vec_id", F.col("embedding").alias("vec"))
    return WordVectors(vecs, code % (rows + rows // 10), rows, dim)
