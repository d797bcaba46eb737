"""Shared helpers: table access, folds, words of raw bytes, hashes.

Missing values have one meaning in the whole subpackage: a null text is an empty text, and a null
``doc_id`` is a number larger than all others (``MISSING_ID``) wherever documents are ordered or
joined; it is null again in results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written  # noqa: F401

MISSING_ID = 2**63 - 1
SLICE_BYTES = 1 << 20
MASK = 2**64 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(MISSING_ID))


def text_key(name: str = "text") -> Column:
    """Tells rows that repeat an id with another text apart."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def back_to_null(name: str) -> Column:
    return F.when(F.col(name) != MISSING_ID, F.col(name))


def remainder(divisor: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % divisor


def fits_broadcast(rows: int, row_bytes: int, limit: int = 64 << 20) -> bool:
    return rows * row_bytes <= limit


#: Bytes of one Arrow batch sent to a Python worker, or one longer row.
BATCH_BYTES = 4 << 20


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over rows that hold texts, in batches bounded by bytes.

    Without a bound by bytes, a batch is 10,000 rows of any length, held at once by the executor and
    by its worker. A bound that the session has already is kept; else it is set for the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


# --- bytes and words inside tasks -------------------------------------------------------------

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of rows in them); null is empty.

    A slice holds at most ``most`` bytes, or one longer text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it."""
    inside = ~SEPARATORS[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[bounds] = False  # a row's first byte has nothing before it
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, by prefix sums of a polynomial in the odd ``base``."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=prefix[1:])
    inverse = powers(pow(base, -1, 2**64), n + 1)
    return splitmix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


BYTE_BASE = 0x9E3779B97F4A7C15
BYTE_CODE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hash of each word, computed over pieces of at most ``most`` bytes or one word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        a = starts[i]
        piece = BYTE_CODE[data[a : ends[j - 1]]]
        out[i:j] = run_hashes(piece, starts[i:j] - a, ends[i:j] - a, BYTE_BASE)
        i = j
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
