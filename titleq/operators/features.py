"""Features of single rows: projections without a shuffle of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, text, words
from ..functions.stems import snowball
from ..schemas import SEGMENT_A

#: Most words whose stems tasks look up, and their greatest length: some 30 MB at most, usually 5.
STEMMED_WORDS, STEMMED_LENGTH = 1 << 18, 64
#: Sign before a stem that was looked up.
KNOWN = "."


def left_over(n: Column, tokens: Column) -> Column:
    """How many of ``n`` tokens are missing from the list, at least 0."""
    return F.greatest(F.lit(0), n - F.size(tokens))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct tokens in both lists."""
    return F.size(F.array_intersect(a, b))


def in_segment_a(category: str = "category_1") -> Column:
    return F.coalesce(F.col(category).isin(SEGMENT_A), F.lit(False))


def concise_features(
    products: DataFrame, title: str = "title", description: str = "description"
) -> DataFrame:
    """The token features of the conciseness model.

    Tokens are those of the cleaned texts, the length is that of the title as given. Word tokens do
    not depend on the cleaning, as it blanks none of their characters.
    """
    df = products.withColumns(
        {
            "_ws": text.ws_tokens(text.strip_special(text.text(title))),
            "_word": text.words(text.text(title)),
            "_des": text.useful_words(text.text(description)),
        }
    ).withColumn("_nsw", text.without(F.col("_word"), words.STOP_WORDS))
    df = df.withColumns(
        {
            "title_character_count": F.length(text.text(title)),
            "original_tokens": F.size("_ws"),
            "regex_tokens": left_over(F.size("_ws"), F.col("_word")),
            "nsw_tokens": F.size("_nsw"),
            "des_tokens": F.size("_des"),
            "des_same": overlap(F.col("_word"), F.col("_des")),
            "repeat_tokens": F.size("_nsw") - F.size(F.array_distinct("_nsw")),
        }
    ).withColumns(
        {
            "sw_tokens": F.greatest(F.lit(0), F.col("original_tokens") - F.col("nsw_tokens"))
            - F.col("regex_tokens"),
            "tit_des_ratio": F.coalesce(
                F.try_divide(F.col("nsw_tokens"), F.col("des_tokens")), F.lit(1.0)
            ),
        }
    )
    return df.drop("_ws", "_word", "_des", "_nsw")


def word_lists(products: DataFrame, stemmed: bool = False) -> DataFrame:
    """(index, title_words, desc_words, cat_words) without stop words, stemmed on demand."""
    cats = F.array_union(
        F.array_union(text.words(text.text("category_1")), text.words(text.text("category_2"))),
        text.words(text.text("category_3")),
    )
    lists = products.select(
        "index",
        text.useful_words(text.text("title")).alias("title_words"),
        text.useful_words(text.text("description")).alias("desc_words"),
        cats.alias("cat_words"),
    )
    return stemmed_lists(lists, lists.columns[1:]) if stemmed else lists


def stemmed_lists(rows: DataFrame, columns: list[str], stem=snowball) -> DataFrame:
    """``rows`` with every word of the list ``columns`` replaced by its stem; words hold no ``KNOWN`` sign, lists no null.

    A stem costs as much as reading hundreds of words. So the most frequent words are stemmed once: at most
    ``STEMMED_WORDS`` short ones, which tasks look up. Any other word is stemmed where it stands.
    """
    spark = rows.sparkSession
    counted = rows.select(F.explode(F.concat(*columns)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequent = counted.where(F.length("word") <= STEMMED_LENGTH).orderBy(F.desc("n"), "word").limit(STEMMED_WORDS)
    frequent = frequent.select("word").repartition(spark.sparkContext.defaultParallelism)
    table = frequent.select("word", F.concat(F.lit(KNOWN), stem(F.col("word"))).alias("stem")).toArrow()
    sent = spark.sparkContext.broadcast([table[c].combine_chunks() for c in ("word", "stem")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known = sent.value
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in columns:
                    tokens = column.flatten()
                    found = pc.coalesce(known.take(pc.index_in(tokens, value_set=listed)), tokens)
                    column = pa.ListArray.from_arrays(pc.subtract(column.offsets, column.offsets[0]), found)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    looked_up = rows.mapInArrow(run, rows.schema)
    rest = lambda w: F.when(w.startswith(KNOWN), F.substring(w, 2, 2 * STEMMED_LENGTH)).otherwise(stem(w))
    return looked_up.withColumns({c: F.transform(c, rest) for c in columns})


def tag_counts(df: DataFrame, title: str = "title") -> DataFrame:
    """Counts and shares of numbers, adjectives, nouns and connecting signs among the tokens."""
    df = df.withColumn("_tags", F.transform(tags.raw_tokens(text.text(title)), tags.tag))
    n = F.size("_tags")
    kinds = {"num": ["NUM"], "adj": ["ADJ"], "noun": ["NOUN", "PROPN"], "conj": ["SYM", "CCONJ"]}
    out = df
    for kind, names in kinds.items():
        out = out.withColumn(f"count_{kind}", F.size(F.filter("_tags", lambda t: t.isin(names))))
    for kind in kinds:
        share = F.coalesce(F.try_divide(F.col(f"count_{kind}"), n), F.lit(0.0))
        out = out.withColumn(f"freq_{kind}", share)
    return out.drop("_tags")


def special_char_count(c: Column) -> Column:
    """Characters that are neither ASCII letters, digits nor blanks."""
    return F.regexp_count(c, F.lit("[^a-zA-Z0-9 ]"))


def price_in(amount: Column, country: Column, rates: dict[str, float]) -> Column:
    """Amount times the rate of its country; unlisted countries keep the amount."""
    factor = F.lit(1.0)
    for name, rate in rates.items():
        factor = F.when(country == name, rate).otherwise(factor)
    return amount * factor
