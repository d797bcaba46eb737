"""Substring dedup with difference-cover anchors.

Rows are compared by runs of ``WINDOW`` words. Hashing every run would move a row for every word, so
only short runs of ``RUN`` words that start at a cover position are hashed at first: positions whose
remainder by ``PERIOD`` lies in a difference cover. Whatever the two places at which a text passage of
``WINDOW`` words stands in two documents, some distance below ``PERIOD`` leads both to cover
positions at once, and as ``PERIOD - 1 + RUN = WINDOW`` the short run there lies inside the passage.
So a shared passage always shares an anchor.

1. Anchors held by two different texts are found by a sum per anchor.
2. They are set in a bit table of fixed size (Bloom filter). It only spares work: a text extends
   every anchor that it lets through to the windows around it, and hashes those in full (128 bits).
   A wrongly passed anchor adds windows that match nothing.
3. Windows are grouped by hash, the smallest id of each is found, and joined back to the windows of
   larger ids. All sums are taken before shuffles; joins on a much-repeated hash can be cut by
   adaptive execution.

Exact copies of a text share all anchors among themselves; they count as one text in step 1 and are
judged by their smallest id alone.

Null or empty texts have no words: nothing is removed and the kept text is empty. Texts below
``WINDOW`` words lose nothing. Documents with equal ids never remove each other's words; repeated
rows get equal results. A null doc_id is larger than all others and stays null in results. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    MISSING_ID,
    as_signed,
    back_to_null,
    byte_slices,
    doc_key,
    fits_broadcast,
    list_array,
    map_texts,
    run_hashes,
    splitmix,
    text_key,
    word_bounds,
    word_hashes,
    written,
)

WINDOW = 50
#: A perfect difference set of the projective plane of order five.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
RUN = WINDOW - PERIOD + 1
#: Bits of the filter: sixteen for each shared anchor, between these bounds (8 and 128 MB).
LEAST_BITS, MOST_BITS = 1 << 26, 1 << 30
PROBES = 4
RUN_BASE, WINDOW_BASE, SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the runs of ``RUN`` words that start at cover positions."""
    n = len(codes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at + RUN <= n]
    return at, run_hashes(codes, at, at + RUN, RUN_BASE)


def _class_of(words: list[bytes]) -> tuple[str, int]:
    digest = hashlib.sha256(b" ".join(words))
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "little", signed=True)


def _texts(batch: pa.RecordBatch, column: int):
    """(row in the batch, bytes, word hashes) of each text."""
    for first, last, data, bounds in byte_slices(batch.column(column)):
        starts, ends, firsts = word_bounds(data, bounds)
        codes = word_hashes(data, starts, ends)
        for k in range(last - first):
            yield first + k, data[bounds[k] : bounds[k + 1]].tobytes(), codes[firsts[k] : firsts[k + 1]]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, classes = [], []
        for _, raw, codes in _texts(batch, 0):
            at, hashes = _anchors(codes)
            if len(at):
                hashes = np.unique(hashes)
                found.append(hashes)
                classes.append(np.full(len(hashes), _class_of(raw.split())[1], np.int64))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(np.concatenate(found))), pa.array(np.concatenate(classes))], names=["anchor", "class"]
            )


# --- the filter ---------------------------------------------------------------------------------


def _bits(anchors: np.ndarray, size: int) -> np.ndarray:
    """The probes of each anchor: bit numbers below the power of two ``size``."""
    x = anchors.view(np.uint64)
    probes = [splitmix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 2**64 - 1)) & np.uint64(size - 1) for i in range(PROBES)]
    return np.stack(probes, axis=1)


def _filter(shared: DataFrame, size: int) -> np.ndarray:
    """Bit table of the anchors. Its size is bounded, whatever the number of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy(), size))
            cells, bit = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array((np.uint64(1) << bit).view(np.int64))], names=["cell", "bits"]
            )

    cells = shared.select("anchor").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(size >> 6, np.uint64)
    got = cells.toArrow()
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(anchors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    probe = _bits(anchors, len(bits) << 6)
    return ((bits[probe >> np.uint64(6)] >> (probe & np.uint64(63))) & np.uint64(1)).all(axis=1)


# --- windows ------------------------------------------------------------------------------------

_SCAN = """_id long, _row long, n_words long, sha string, class long, text string, h1 array<long>, h2 array<long>, starts array<int>"""


def _scan(docs: DataFrame, bits) -> DataFrame:
    """One row per document; those with a passed anchor carry their text and their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            rows: list[tuple] = []
            weight = 0
            for row, raw, codes in _texts(batch, 2):
                words = raw.split()
                sha, code = _class_of(words)
                at, hashes = _anchors(codes)
                starts = np.zeros(0, np.int64)
                if len(at):
                    at = at[_passes(hashes, table)]
                    mark = np.zeros(len(codes) + 1, np.int64)
                    np.add.at(mark, np.maximum(at - (PERIOD - 1), 0), 1)
                    np.add.at(mark, at + 1, -1)
                    starts = np.flatnonzero(np.cumsum(mark)[: len(codes) - WINDOW + 1] > 0)
                rows.append((
                    row, len(words), sha, code, raw if len(starts) else None,
                    run_hashes(codes, starts, starts + WINDOW, WINDOW_BASE) if len(starts) else np.zeros(0, np.uint64),
                    run_hashes(codes, starts, starts + WINDOW, SECOND_BASE) if len(starts) else np.zeros(0, np.uint64),
                    starts,
                ))
                weight += len(raw) + 20 * len(starts) + 200
                if weight > 8 << 20:
                    yield _packed(batch, rows)
                    rows, weight = [], 0
            if rows:
                yield _packed(batch, rows)

    return map_texts(docs.select(doc_key().alias("_id"), text_key().alias("_row"), F.col("text").cast("string").alias("text")), run, _SCAN)


def _packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    row, n, sha, code, raw, h1, h2, starts = zip(*rows)
    counts = np.array([len(s) for s in starts])
    arrays = [
        batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(n, pa.int64()), pa.array(sha), pa.array(code, pa.int64()),
        pa.array(raw, pa.binary()).cast(pa.string()),
        list_array(pa.array(as_signed(np.concatenate(h1))), counts),
        list_array(pa.array(as_signed(np.concatenate(h2))), counts),
        list_array(pa.array(np.concatenate(starts).astype(np.int32)), counts),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["_id", "_row", "n_words", "sha", "class", "text", "h1", "h2", "starts"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words left after the removal of all words that a removed window covers."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            removed, sha, kept = 0, r["sha"], None
            if r["copy"]:
                removed, kept = r["n_words"], ""
                sha = hashlib.sha256(b"").hexdigest()
            elif r["removed"]:
                words = r["text"].encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(r["removed"], np.int64))
                gone[at] += 1
                np.add.at(gone, at + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                left = b" ".join(w for w, g in zip(words, gone) if not g)
                removed, kept, sha = int(gone.sum()), left.decode(), hashlib.sha256(left).hexdigest()
            rows.append((r["_id"], r["_row"], r["n_words"], removed, kept, sha))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["_id", "_row", "n_words", "n_removed", "kept", "kept_sha256"]
        )


def _judged(docs: DataFrame) -> DataFrame:
    """(_id, _row, n_words, n_removed, kept, kept_sha256); kept is null where nothing is removed."""
    spark = docs.sparkSession
    anchors = map_texts(docs.select(F.col("text").cast("string").alias("text")), _anchor_rows, "anchor long, class long")
    shared = anchors.groupBy("anchor").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    shared = written(shared.select("anchor"), "shared_anchors")
    size, n_shared = LEAST_BITS, shared.count()
    while size < MOST_BITS and size < 16 * n_shared:
        size *= 2
    bits = spark.sparkContext.broadcast(_filter(shared, size))
    scan = written(_scan(docs, bits), "windows")

    windows = scan.where(F.size("starts") > 0).select(
        "_id", "_row", F.inline(F.arrays_zip("h1", "h2", "starts"))
    )
    first = windows.groupBy("h1", "h2").agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
    first = first.where("least < most").select("h1", "h2", "least")
    removed = windows.join(first, ["h1", "h2"]).where("least < _id").select(
        "_id", "_row", "starts", F.lit(False).alias("copy")
    )
    origin = scan.groupBy("sha").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most")
    copies = (
        scan.where(F.col("n_words") >= WINDOW).select("_id", "_row", "sha")
        .join(origin.select("sha", "least"), "sha").where("least < _id")
        .select("_id", "_row", F.lit(None).cast("int").alias("starts"), F.lit(True).alias("copy"))
    )
    spans = removed.unionByName(copies).groupBy("_id", "_row").agg(
        F.collect_set("starts").alias("removed"), F.max("copy").alias("copy")
    )
    judged = (
        scan.select("_id", "_row", "n_words", "sha", "text")
        .join(spans, ["_id", "_row"], "left")
        .select("_id", "_row", "n_words", "sha", "copy", "removed", F.when(F.size("removed") > 0, F.col("text")).alias("text"))
    )
    return map_texts(judged, _kept, "_id long, _row long, n_words long, n_removed long, kept string, kept_sha256 string")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row; kept is null if nothing goes."""
    return _judged(docs).select(
        back_to_null("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept words; rows that lose nothing are left as they are.

    ``n_chars``, if there is such a column, follows the text. No row is dropped, and other columns may have any names.
    """
    taken = {c.lower() for c in docs.columns}
    number, row, kept = (next(n for n in (f"_cut_{c}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for c in ("id", "row", "kept"))
    cut = _judged(docs).where("n_removed > 0").select(
        F.col("_id").alias(number), F.col("_row").alias(row), F.col("kept").alias(kept)
    ).dropDuplicates([number, row])
    cut = written(cut, "cut_texts")
    same = (doc_key() == F.col(number)) & (text_key() == F.col(row))
    keys = cut.select(number, row)
    text = F.coalesce(kept, "text")
    columns = [text.alias(c) if c == "text" else F.when(F.col(number).isNotNull(), F.length(kept).cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    if not fits_broadcast(keys.count(), 64):
        return docs.join(cut, same, "left").select(*columns)
    # Few enough keys to send: only texts that change move.
    changed = docs.join(F.broadcast(keys), same, "left_semi").join(cut, same).select(*columns)
    return docs.join(F.broadcast(keys), same, "left_anti").unionByName(changed)
