"""SimHash fingerprints, linked by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments, and each is decoded by the perfect binary Golay
code of 23 bits to the index of the one codeword within three bits. Two fingerprints with at most
four differing bits have, by the pigeonhole principle, two segments with at most two differing bits
together. Halfway between those two pairs of segments lies one that differs from either in one bit
at most; so, if every pair of segments gives as keys the codeword indices of itself and of all its
one-bit changes, the two share a key. As most changes decode to the same codeword, a fingerprint has
about 30 keys of 24 bits. Fingerprints that share a key are compared bit by bit.

Equal fingerprints are one node. A key shared by more than ``BLOCK`` fingerprints is dealt to blocks
so that each pair of blocks is one task-sized group; a group puts out its members' tie to the
smallest of their component within the group, never its pairs. No link is lost by this.

A null or empty text has no words and the fingerprint zero, which is linked like any other.
Repeated rows get equal results. A null doc_id counts as larger than all others and stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MISSING_ID, as_signed, back_to_null, byte_slices, doc_key, map_texts, word_bounds, written
from .components import components

SHINGLE = 4
MOST_BITS = 4
SEED = 42
BLOCK = 2048
#: Lowest bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # both look at ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        codes = [xxhash.xxh64_intdigest(joined, seed)]
        return codes[0]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.zeros(len(words), np.int64)
    starts[1:] = ends[:-1] + 1
    counts = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        spans = zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist())
        codes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        counts += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, bounds in byte_slices(batch.column(1)):
                raw = data.tobytes()
                out += [fingerprint(raw[a:b], shingle, seed) for a, b in zip(bounds[:-1], bounds[1:])]
            fps = pa.array(as_signed(np.array(out, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts, run, "doc_id long, fp long")


# --- the code -----------------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator, bit by bit."""
    rest = np.zeros(words.shape, np.uint32)
    for bit in range(23):
        value = 1 << bit
        for top in range(22, 10, -1):
            if value >> top & 1:
                value ^= GENERATOR << (top - 11)
        rest ^= np.where(words >> np.uint32(bit) & np.uint32(1), np.uint32(value), np.uint32(0))
    return rest


def _error_of_syndrome() -> np.ndarray:
    """The error of at most three bits behind each of the 2048 syndromes."""
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.array(errors, np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_syndromes(errors)] = errors
    return out


def decode(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    return (words ^ errors[_syndromes(words)]) >> np.uint32(11)


def fuzzy_keys(fps: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) without repetition: the keys of each fingerprint."""
    own, near = [], []
    for low, width in SEGMENTS:
        segment = (fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32)
        own.append(decode(segment, errors).astype(np.int64))
        flips = segment[:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))
        near.append(decode(flips, errors).astype(np.int64))
    keys = []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        tag = pair << 24
        keys.append((tag | own[i] << 12 | own[j])[:, None])
        keys.append(tag | near[i] << 12 | own[j][:, None])
        keys.append(tag | own[i][:, None] << 12 | near[j])
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


# --- links --------------------------------------------------------------------------------------


def ties(fps: np.ndarray, nodes: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """(node, smallest node of its component) within one group, found breadth first."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= most_bits
            if near.any():
                reached = left[near]
                left = left[~near]
                front.extend(reached.tolist())
                out += [(n, int(nodes[root])) for n in nodes[reached].tolist()]
    return out


def links(nodes: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): ties between nodes (fp, node), whose components are those of all links."""
    if most_bits > 4:
        raise ValueError("two of three segments hold at most two errors only up to four bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = _error_of_syndrome()
        for batch in batches:
            fps, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i in range(0, len(fps), 4096):
                row, key = fuzzy_keys(fps[i : i + 4096], errors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(fps[i + row].view(np.int64)), pa.array(ids[i + row])],
                    names=["key", "fp", "node"],
                )

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = batch.column(0), batch.column(1)
            ends = fps.offsets.to_numpy()
            fps = fps.values.to_numpy().view(np.uint64)
            ids = ids.values.to_numpy()
            two = np.diff(ends) == 2
            at = ends[:-1][two]
            near = np.bitwise_count(fps[at] ^ fps[at + 1]) <= most_bits
            pairs = [(max(a, b), min(a, b)) for a, b in zip(ids[at[near]].tolist(), ids[at[near] + 1].tolist())]
            for a, b in zip(ends[:-1][~two].tolist(), ends[1:][~two].tolist()):
                pairs += ties(fps[a:b], ids[a:b], most_bits)
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = nodes.select("fp", "node").mapInArrow(keyed, "key long, fp long, node long")
    hot = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot_keys")
    lists = F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")
    cold = keys.join(hot, "key", "left_anti").groupBy("key").agg(*lists)
    # A hot key with n members has n/block blocks; a member of block i meets each block j once, in
    # the group of the pair (i, j).
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    split = (
        keys.join(hot, "key")
        .select("key", "fp", "node", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
        .groupBy("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
        .agg(*lists)
    )
    grouped = cold.select("fps", "nodes").unionByName(split.select("fps", "nodes"))
    return grouped.where(F.size("fps") > 1).mapInArrow(tied, "a long, b long")


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reached."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    keyed = prints.select("doc_id", "fp", doc_key().alias("_id"))
    nodes = written(keyed.groupBy("fp").agg(F.min("_id").alias("node")), "nodes")
    roots = components(links(nodes, most_bits))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("_root"))
    return keyed.join(named, "fp").select("doc_id", "fp", back_to_null("_root").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group.

    Rows that repeat an id stay or go together. Rows without an id stay together if some group has
    none but such rows.
    """
    groups = near_groups(docs, **options)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.coalesce("doc_id", F.lit(MISSING_ID)).alias("_keep")
    ).distinct()
    return docs.join(keep, doc_key() == keep["_keep"], "left_semi")
