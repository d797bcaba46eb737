"""Frequent word sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def fit(rows: DataFrame, tokens: str, support: float = 0.1, confidence: float = 0.5) -> FPGrowthModel:
    """FP-growth over the distinct words of each row."""
    items = rows.select(F.array_distinct(tokens).alias("items"))
    grown = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence)
    return grown.fit(items)


def itemsets(model: FPGrowthModel) -> DataFrame:
    """(items, freq) with the items of a set in alphabetical order, so sets compare equal."""
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")


# ---- vertical search -----------------------------------------------------------------------------

#: Rows whose membership one block of bits holds.
BLOCK_ROWS = 1 << 15


def frequent_items(rows: DataFrame, tokens: str, support: float) -> tuple[list[str], int, int]:
    """(items in order, least number of rows, number of rows): items in at least ``support`` of the rows.

    There are at most 1 / support times as many as an average row has, so they fit the driver.
    """
    total = rows.count()
    need = max(1, math.ceil(support * total))
    counts = rows.select(F.explode(F.array_distinct(tokens)).alias("item")).where("item IS NOT NULL").groupBy("item").count()
    return sorted(r.item for r in counts.where(F.col("count") >= need).select("item").collect()), need, total


def _bit_rows(rows: DataFrame, tokens: str, items: list[str]) -> DataFrame:
    """(bits): for each block of rows one bitset per item, side by side, in the items' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(items, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                lists = batch.column(0).slice(at, BLOCK_ROWS)
                found = pc.index_in(lists.flatten(), value_set=names)
                row = pc.list_parent_indices(lists).filter(found.is_valid()).to_numpy()
                member = np.zeros((len(items), -(-len(lists) // 64) * 64), bool)
                member[found.drop_null().to_numpy(), row] = True
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(member, axis=1).tobytes()], pa.binary())], names=["bits"])

    return rows.select(F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("items")).mapInArrow(run, "bits binary")


def _supports(blocks: DataFrame, width: int, candidates: np.ndarray) -> np.ndarray:
    """Number of rows that hold each candidate (item numbers in a row), summed over the blocks in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for value in batch.column(0):
                bits = np.frombuffer(value.as_buffer(), np.uint64).reshape(width, -1)
                step = max(1, (1 << 21) // bits.shape[1])
                for at in range(0, len(candidates), step):
                    part = candidates[at : at + step]
                    both = bits[part[:, 0]]
                    for place in range(1, part.shape[1]):
                        both = both & bits[part[:, place]]
                    total[at : at + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["candidate", "freq"])

    found = blocks.mapInArrow(run, "candidate long, freq long").groupBy("candidate").agg(F.sum("freq").alias("freq")).toArrow()
    out = np.zeros(len(candidates), np.int64)
    out[found["candidate"].to_numpy()] = found["freq"].to_numpy()
    return out


def _next_level(sets: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets one larger whose every part one smaller is frequent."""
    known, by_start = set(sets), {}
    for s in sets:
        by_start.setdefault(s[:-1], []).append(s[-1])
    grown = [start + (a, b) for start, ends in by_start.items() for i, a in enumerate(sorted(ends)) for b in sorted(ends)[i + 1 :]]
    return [g for g in grown if all(g[:i] + g[i + 1 :] in known for i in range(len(g)))]


def vertical(rows: DataFrame, tokens: str, support: float = 0.1) -> DataFrame:
    """(items, freq): all frequent word sets of the rows, however large, items in order.

    The rows are written once as bitsets of the frequent items. Each level is one scan that intersects them for
    the candidates of that level, which are the sets whose parts are all frequent. The driver holds the sets of a level.
    """
    items, need, _ = frequent_items(rows, tokens, support)
    spark = rows.sparkSession
    schema = "items array<string>, freq long"
    if not items:
        return spark.createDataFrame([], schema)
    blocks = written(_bit_rows(rows, tokens, items), "item_bits")
    out: list[tuple[list[str], int]] = []
    level: list[tuple[int, ...]] = [(i,) for i in range(len(items))]
    while level:
        freq = _supports(blocks, len(items), np.array(level))
        level = [s for s, n in zip(level, freq) if n >= need]
        out += [([items[i] for i in s], int(n)) for s, n in zip(level, freq[freq >= need])]
        level = _next_level(level)
    return spark.createDataFrame(out, schema)


def rules(sets: DataFrame, total: int, confidence: float = 0.5) -> DataFrame:
    """(antecedent, consequent, confidence, lift, support): rules with one consequent from all frequent sets (items, freq)."""
    parts = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("consequent"))
    parts = parts.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    first = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("first"))
    second = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("freq").alias("second"))
    found = parts.join(first, "antecedent").join(second, "consequent").withColumn("confidence", F.col("freq") / F.col("first"))
    lift = F.col("confidence") / (F.col("second") / total)
    return found.where(F.col("confidence") >= confidence).select(
        "antecedent", "consequent", "confidence", lift.alias("lift"), (F.col("freq") / total).alias("support")
    )
