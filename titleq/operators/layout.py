"""How rows are laid out: spreading, hot keys, lookups, running totals."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

HOT_PARTS = 1000
MAX_BUCKETS = 20_000
BROADCAST_BYTES = 64 << 20


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute by a unique key if the scan has fewer splits than there are cores.

    Per-row text work on a large table already has many splits and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def by_key(df: DataFrame, key: str = "index") -> DataFrame:
    """One shuffle by a unique key; later groupings by the key or more columns need none."""
    return df.repartition(shuffle_width(df), key)


def hot_parts(df: DataFrame, row_bytes: int) -> int:
    """Into how many parts rows are thought to be cut when a key is called hot.

    Several times the number of shuffle partitions, so that a key that is not hot fits a task, but
    never so many that the hot rows of a table would exceed the broadcast limit.
    """
    return max(1, min(max(HOT_PARTS, 4 * shuffle_width(df)), BROADCAST_BYTES // row_bytes))


def hot_keys(freq: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """Keys that hold more than one ``parts``-th of all rows, from a (key, n) table.

    There are fewer than ``parts`` such keys whatever the data, so the result may be broadcast.
    """
    total = freq.agg(F.sum("n"))
    return freq.where(F.col("n") * parts > total.scalar()).select(key)


def split_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    freq: DataFrame | None = None,
    keep: bool = False,
    stored: bool = False,
    row_bytes: int = 200,
    parts: int | None = None,
) -> DataFrame:
    """Attach the columns of ``table`` (unique ``key``) to ``rows``, whatever the skew.

    Rows with a hot key meet a broadcast of the fewer than ``parts`` hot table rows and do not
    move. The others are joined by an ordinary shuffle in which no key holds more than one
    ``parts``-th of the rows. ``keep`` keeps rows without a match, null keys included. The rows are
    read by each of these branches and stored first unless they are ``stored`` already.
    ``row_bytes`` bounds the size of a table row.
    """
    parts = parts or hot_parts(rows, row_bytes)
    if not stored:
        rows = written(rows, "lookup_rows")
    if freq is None:
        freq = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    how = "left" if keep else "inner"
    hot = hot_keys(freq, key, parts)
    hot_table = table.join(F.broadcast(hot), key, "left_semi")
    if keep:
        hot_table = hot.join(F.broadcast(hot_table), key, "left")
    on_hot = rows.join(F.broadcast(hot_table), key)
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti")
    out = on_hot.unionByName(cold.join(table, key, how))
    if keep:
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def lookup(
    rows: DataFrame, table: DataFrame, key: str, table_rows: int, row_bytes: int
) -> DataFrame:
    """Inner join with a stored table of known size: broadcast if it is small, else split."""
    if table_rows * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key)
    return split_lookup(rows, table, key, row_bytes=row_bytes)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Adds ``_bucket``, a number that grows with the numeric ``key``, with about equal counts.

    Only the bucket edges come to the driver. They are plain numbers in the plan, so every
    recomputation of a lost task puts a row into the same bucket.
    """
    buckets = buckets or min(4 * shuffle_width(df), MAX_BUCKETS)
    marks = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    edges = [float("-inf"), *sorted(set(marks)), float("inf")]
    if len(edges) < 3:
        return df.withColumn("_bucket", F.lit(0))
    # Bucketizer reads doubles; long keys keep their order, and equal doubles share a bucket.
    probe = df.withColumn("_probe", F.col(key).cast("double"))
    cut = Bucketizer(splits=edges, inputCol="_probe", outputCol="_bucket").transform(probe)
    return cut.withColumn("_bucket", F.col("_bucket").cast("int")).drop("_probe")


def running_total(
    df: DataFrame,
    key: str,
    value: Column,
    name: str,
    groups: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows with a smaller ``key`` (unique within the few ``groups``).

    Two passes: totals per bucket, whose running sums are a broadcast of at most
    groups x buckets rows; then a window inside each bucket. No task sees the whole table.
    """
    cut = bucketed(df, key, buckets).withColumn("_value", value)
    totals = cut.groupBy(*groups, "_bucket").agg(F.sum("_value").alias("_sum"))
    anchor = [F.col(g) for g in groups] or [F.lit(0)]
    earlier = Window.partitionBy(*anchor).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *groups, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        cut.join(F.broadcast(offsets), [*groups, "_bucket"])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_before")
    )


def row_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Dense row number from 1 in the order of a unique numeric key."""
    return running_total(df, key, F.lit(1).cast("long"), "_earlier").withColumn(
        name, F.col("_earlier") + 1
    ).drop("_earlier")


def order_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense row numbers from 0 in the order of columns of any type; stored.

    Rows are sorted in ranges, so no task sees more than a range of them, and numbered inside each
    range; the ranges' sizes are a broadcast of one row per shuffle partition. Ranges are drawn from a
    sample, so they are stored before they are counted. Equal rows are numbered in any order.
    """
    rows = df.repartitionByRange(shuffle_width(df), *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_inside": inside}), "ordered_rows")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    numbered = rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside"))
    return written(numbered.drop("_part", "_inside", "_before"), "numbered_rows")
