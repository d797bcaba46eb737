"""Lexicon and topic features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .layout import BROADCAST_BYTES, split_lookup

#: A lexicon word and its flags in memory.
ROW_BYTES = 100


def lexicon_union(*lexicons: DataFrame) -> DataFrame:
    """Set union of one-column word tables."""
    return reduce(DataFrame.unionByName, lexicons).distinct()


def lexicon_counts(titles: DataFrame, lexicons: dict[str, DataFrame]) -> DataFrame:
    """Per row: token count, characters, and count and share of the tokens in each lexicon.

    ``titles`` has (index, tokens); the lexicons are one-column tables ``token``. All lexicons are
    merged into one table of flags, so the tokens are looked up once: by a broadcast, where tokens
    don't move, if the table is small, else by the lookup that copes with hot words.
    """
    names = list(lexicons)
    tagged = reduce(
        DataFrame.unionByName,
        [lex.select("token", F.lit(name).alias("_lex")) for name, lex in lexicons.items()],
    )
    flags = tagged.groupBy("token").agg(
        *[F.max((F.col("_lex") == n).cast("int")).alias(f"_is_{n}") for n in names]
    )
    flags = written(flags, "lexicon_flags")
    tokens = titles.select("index", F.explode_outer("tokens").alias("token"))
    if flags.count() * ROW_BYTES <= BROADCAST_BYTES:
        found = tokens.join(F.broadcast(flags), "token", "left")
    else:
        found = split_lookup(tokens, flags, "token", keep=True)
    counts = found.groupBy("index").agg(
        *[F.coalesce(F.sum(f"_is_{n}"), F.lit(0)).cast("int").alias(f"count_{n}") for n in names],
        F.count("token").cast("int").alias("count_words"),
        F.coalesce(F.sum(F.length("token")), F.lit(0)).cast("int").alias("count_chars"),
    )
    return counts.withColumns(
        {
            f"freq_{n}": F.coalesce(
                F.try_divide(F.col(f"count_{n}"), F.col("count_words")), F.lit(0.0)
            )
            for n in names
        }
    )


def top_terms(words: DataFrame, group: str, k: int = 30) -> DataFrame:
    """The ``k`` most frequent tokens per group, ties by token: at most groups x k rows.

    Counting combines before the shuffle, and every task drops tokens beyond its own top ``k``
    before the ranking window, so no task sees a whole group.
    """
    counts = words.groupBy(group, "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "token")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col(group).alias("topic"), F.col("token").alias("term"), "rank")
    )


def topic_lists(terms: DataFrame) -> Column:
    """The terms of all topics as one array<array<string>> value (topics x k words)."""
    lists = terms.groupBy("topic").agg(F.collect_list("term").alias("terms"))
    return lists.agg(F.collect_list("terms")).scalar()


def topic_overlap(df: DataFrame, tokens: str, topics: Column) -> DataFrame:
    """Largest overlap with a topic's terms, and how many topics are hit; 0 and 0 if none."""
    hits = F.transform("_terms", lambda t: F.size(F.array_intersect(F.col(tokens), t)))
    return (
        df.withColumn("_terms", topics)
        .withColumn("_topics", hits)
        .withColumns(
            {
                "max_words_topic": F.coalesce(F.array_max("_topics"), F.lit(0)),
                "topic_num": F.size(F.filter("_topics", lambda h: h > 0)),
            }
        )
        .drop("_terms", "_topics")
    )
