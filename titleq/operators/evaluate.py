"""Splits and metrics. Every metric is one grouped aggregation over (label, prediction, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .layout import row_index, running_total

THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def share(key: Column) -> Column:
    """A number in [0, 1) that depends only on the key, not on partitions or run."""
    head = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 32))


def split(df: DataFrame, train: float = 0.7, key: str = "index") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the share of the key."""
    mark = share(F.col(key))
    return df.where(mark < train), df.where(mark >= train)


def with_folds(df: DataFrame, k: int, key: str) -> DataFrame:
    """Contiguous folds in key order; the first n mod k folds have one row more."""
    rows = row_index(df, key, "_row").withColumn("_row", F.col("_row") - 1)
    n = df.agg(F.count("*")).scalar()
    rows = rows.withColumn("_n", n)
    small, larger = F.expr(f"_n div {k}"), F.col("_n") % k
    cut = larger * (small + 1)
    fold = F.when(F.col("_row") < cut, F.expr(f"_row div (_n div {k} + 1)")).otherwise(
        larger + F.floor((F.col("_row") - cut) / F.greatest(small, F.lit(1)))
    )
    return rows.withColumn("fold", fold.cast("int")).drop("_row", "_n")


def oversample(df: DataFrame, label: str, minority: int = 0, times: int = 10) -> DataFrame:
    """Rows of the minority label ``times`` times, numbered by ``copy``."""
    n = F.when(F.col(label) == minority, times).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def accuracy(label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def rmse(label: str, score: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(label) - F.col(score), F.lit(2.0))))


def f1_macro(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean over the classes 0 and 1 of their F1 scores; an absent class scores 0."""

    def f1(k: int) -> Column:
        hit = F.count_if((F.col(label) == k) & (F.col(prediction) == k))
        total = F.count_if(F.col(label) == k) + F.count_if(F.col(prediction) == k)
        return F.coalesce(F.try_divide(2.0 * hit, total), F.lit(0.0))

    return df.agg(((f1(0) + f1(1)) / 2).alias("f1_macro"))


def auc(
    df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact area under the ROC curve, per (few) groups: rows are first counted per distinct score.

    Null for a group that lacks a class.
    """
    counts = written(
        df.groupBy(*by, score).agg(
            F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
        ),
        "score_counts",
    )
    ranked = running_total(counts, score, F.col("q"), "below", groups=by)
    wins = F.sum(F.col("p").cast("double") * (F.col("below") + F.col("q") / 2))
    pairs = F.sum("p").cast("double") * F.sum("q")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def quantile(df: DataFrame, value: str, group: str, q: float) -> DataFrame:
    """Exact interpolated quantile per (few) groups, from counts per distinct value."""
    counts = written(df.groupBy(group, value).agg(F.count("*").alias("n")), "value_counts")
    ranked = running_total(counts, value, F.col("n"), "below", groups=(group,))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    ranked = ranked.join(F.broadcast(sizes), group)
    place = (F.col("size") - 1) * F.lit(q)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    ends = ranked.groupBy(group).agg(
        F.max(F.when(holds(low), F.col(value))).alias("_low"),
        F.max(F.when(holds(high), F.col(value))).alias("_high"),
        F.max(place - low).alias("_part"),
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return ends.select(group, between.alias("cut"))


def threshold_sweep(
    df: DataFrame, by: list[str], label: str = "label", score: str = "score"
) -> DataFrame:
    """Accuracy, share of zeros, RMSE and confusion counts of ``score > t`` for every t.

    All thresholds are columns of one aggregation; rows are not multiplied.
    """
    y, s = F.col(label), F.col(score)
    cells = []
    for i, t in enumerate(THRESHOLDS):
        one = s > t
        cells += [
            F.count_if((y == 0) & ~one).alias(f"tn_{i}"),
            F.count_if((y == 0) & one).alias(f"fp_{i}"),
            F.count_if((y == 1) & ~one).alias(f"fn_{i}"),
            F.count_if((y == 1) & one).alias(f"tp_{i}"),
        ]
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), rmse(label, score).alias("rmse"), *cells)
    names = ["tn", "fp", "fn", "tp"]
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}_{i}").alias(c) for c in names])
            for i, t in enumerate(THRESHOLDS)
        ]
    )
    return wide.select(*by, "n", "rmse", F.inline(rows)).withColumns(
        {
            "accuracy": (F.col("tn") + F.col("tp")) / F.col("n"),
            "zero_share": (F.col("tn") + F.col("fn")) / F.col("n"),
        }
    )
