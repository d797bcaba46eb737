"""Profiles of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n) of several columns in one pass; null is a value of its own.

    Counts combine before the shuffle, so a value held by most rows costs one row per task.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("name", "value").agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(name, count, mean, stddev, min, max) of numeric columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in columns.items()]
    )
    return df.select(F.inline(pairs)).groupBy("name").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("stddev"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def present(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Flags that tell whether a value is there; NaN counts as missing."""
    kinds = dict(df.dtypes)

    def flag(c: str) -> Column:
        there = F.col(c).isNotNull()
        return there & ~F.isnan(c) if kinds[c] in ("double", "float") else there

    return df.select(*keep, *[flag(c).alias(c) for c in columns])


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by their sample deviation; the statistics are one scalar."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("stats")
    ).scalar()
    out = df.withColumn("_stats", stats)
    for c in columns:
        out = out.withColumn(
            c, F.try_divide(F.col(c) - F.col(f"_stats.m_{c}"), F.col(f"_stats.s_{c}"))
        )
    return out.drop("_stats")
