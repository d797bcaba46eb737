"""MinHash near-duplicates, found by a multi-index Hamming join of signatures.

A document's set holds its distinct word shingles, as 64-bit hashes. Its signature has 32 symbols:
the low 16 bits of the least value of the set under 32 hash functions. The signature distance is the
number of differing symbols; at a similarity of 0.85 it is about 5, and over 15 in about three of a
million pairs. The signature is cut into 8 chunks of 4 symbols. Signatures at a distance of at most
15 have, by the pigeonhole principle, a chunk with at most one error. Every chunk enumerates its
allowed errors by blanking each symbol in turn, so such a pair shares one of 32 keys of 48 bits: all
pairs under the distance threshold are found. Signatures that share a key are compared, and
those near enough are tied to one candidate group.

Equal sets are one node. Inside a candidate group links are confirmed on the full sets, whose hashes
are taken from the texts again for these nodes alone. Each member meets the others of its block of
bounded size, and the group's smallest node as pivot. A group of several blocks goes on with its
members that aren't connected to the pivot: each block of these meets each block of the whole group.
Members connected to the pivot needn't meet each other, since they are in one component already, so
a large group of near copies costs about one comparison a member. Tasks put out ties, never pairs, and no
link between different sets that are candidates is lost. A key shared by more than ``BUCKET`` nodes
ties them all without comparing, which can only make a candidate group larger.

A null text or a text without words has the empty set, is linked with nothing and is kept. Repeated
rows get equal results; rows that repeat a doc_id with another text are judged apart. A null doc_id
counts as larger than all others and stays null; such a row is kept if its component has no other id. An empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BYTE_CODE, as_signed, back_to_null, byte_slices, doc_key, fits_broadcast, map_texts, run_hashes, splitmix, text_key,
    word_bounds, word_hashes, written,
)
from .components import components

SHINGLE = 3
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
SYMBOLS = 32
CHUNK = 4
#: Errors that a chunk may hold; the threshold that all chunks together guarantee.
CHUNK_ERRORS = 1
MOST_ERRORS = SYMBOLS // CHUNK * (CHUNK_ERRORS + 1) - 1
#: Nodes of a key that are compared with each other.
BUCKET = 512
#: Shingles of a block of a candidate group, or one larger set.
BLOCK = 1 << 19
SEED = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- sets and signatures ------------------------------------------------------------------------


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Two words for each hash function, the second one odd."""
    numbers = splitmix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * SEED)
    return numbers[:SYMBOLS], numbers[SYMBOLS:] | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each row's set in ascending order, bounds of rows in them)."""
    data = LOWER[data]
    starts, ends, words = word_bounds(data, bounds)
    codes = word_hashes(data, starts, ends)
    counts = np.diff(words)
    short = (counts > 0) & (counts < shingle)
    windows = np.where(short, 1, np.maximum(counts - shingle + 1, 0))
    before = np.concatenate([[0], np.cumsum(windows)])
    first = np.repeat(words[:-1] - before[:-1], windows) + np.arange(before[-1])
    last = first + np.repeat(np.minimum(counts, shingle), windows)
    hashes = run_hashes(splitmix(codes), first, last, int(BYTE_CODE[7] | np.uint64(1)))
    sets = [np.unique(hashes[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else hashes
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Symbols (rows x SYMBOLS, 16 bits each) of sets that aren't empty."""
    out = np.empty((len(bounds) - 1, SYMBOLS), np.uint16)
    if len(out):
        for k, (flip, factor) in enumerate(zip(*_functions())):
            least = np.minimum.reduceat((flat ^ flip) * factor, bounds[:-1])
            out[:, k] = splitmix(least) & np.uint64(0xFFFF)
    return out


def _set_keys(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, as two longs."""
    keys = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(flat ^ salt), dtype=np.uint64)])
        keys.append(as_signed(splitmix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ salt)))
    return keys[0], keys[1]


def _fixed(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(rows.tobytes())])


def signed_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, k1, k2, sig) of every row; k1 and k2 name the set, sig is null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(2)):
                flat, at = shingle_sets(data, bounds, shingle)
                full = np.flatnonzero(np.diff(at))
                place = np.full(last - first, -1)
                place[full] = np.arange(len(full))
                sig = _fixed(signatures(flat, np.append(at[full], at[-1])))
                k1, k2 = _set_keys(flat, at)
                arrays = [batch.column(i).slice(first, last - first) for i in range(2)]
                arrays += [pa.array(np.diff(at)), pa.array(k1), pa.array(k2), sig.take(pa.array(place, mask=place < 0))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "sig"])

    text = F.col("text").cast("string").alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), text)
    return map_texts(texts, run, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, sig binary")


# --- candidate groups ---------------------------------------------------------------------------


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys (rows x SYMBOLS): each chunk with one of its symbols blanked."""
    keys = np.empty(sigs.shape, np.uint64)
    for at in range(SYMBOLS):
        first = at - at % CHUNK
        key = np.full(len(sigs), at, np.uint64)
        for other in range(first, first + CHUNK):
            if other != at:
                key = key << np.uint64(16) | sigs[:, other]
        keys[:, at] = key
    # A blanked symbol's number fills the 16 bits above the three symbols.
    return keys


def _symbols(sig: pa.Array) -> np.ndarray:
    """Matrix of the symbols in an array of binary values of equal length."""
    width = 2 * SYMBOLS
    start = sig.offset * width
    return np.frombuffer(sig.buffers()[2], np.uint8)[start : start + len(sig) * width].view(np.uint16).reshape(-1, SYMBOLS)


def near_ties(sigs: np.ndarray, nodes: np.ndarray, most: int = MOST_ERRORS) -> list[tuple[int, int]]:
    """(node, smallest node reached) among the members of one key, found breadth first."""
    order = np.argsort(nodes, kind="stable")
    sigs, nodes = sigs[order], nodes[order]
    left = np.arange(len(nodes))
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = (sigs[left] != sigs[front.pop()]).sum(axis=1) <= most
            reached, left = left[near], left[~near]
            front.extend(reached.tolist())
            out += [(n, int(nodes[root])) for n in nodes[reached].tolist()]
    return out


def candidate_ties(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): ties between nodes (node, sig); all pairs under the signature distance are connected."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = as_signed(chunk_keys(_symbols(part.column(1))).ravel())
                row = pa.array(np.repeat(np.arange(part.num_rows), SYMBOLS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column(0).take(row), part.column(1).take(row)], names=["key", "node", "sig"]
                )

    def unsigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keyed(batches):
            yield batch.select(["key", "node"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            at, inner = members.offsets.to_numpy(), members.values
            ids, sigs = inner.field(0).to_numpy(), _symbols(inner.field(1))
            two = np.diff(at) == 2
            i = at[:-1][two]
            i = i[(sigs[i] != sigs[i + 1]).sum(axis=1) <= MOST_ERRORS]
            pairs = list(zip(np.maximum(ids[i], ids[i + 1]).tolist(), np.minimum(ids[i], ids[i + 1]).tolist()))
            for a, b in zip(at[:-1][~two].tolist(), at[1:][~two].tolist()):
                pairs += near_ties(sigs[a:b], ids[a:b])
            pairs = np.array(list(set(pairs)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    sigs = nodes.select("node", "sig")
    keys = sigs.mapInArrow(unsigned, "key long, node long")
    least = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("b"))
    hot = written(least.where(F.col("n") > bucket).select("key", "b"), "hot_keys")
    whole = keys.withColumnRenamed("node", "a").join(hot, "key").select("a", "b")
    rows = sigs.mapInArrow(keyed, "key long, node long, sig binary")
    members = F.collect_list(F.struct("node", "sig")).alias("members")
    cold = rows.join(hot, "key", "left_anti").groupBy("key").agg(members).where(F.size("members") > 1)
    return whole.unionByName(map_texts(cold.select("members"), tied, "a long, b long")).where("a != b").distinct()


# --- confirmation on full sets ------------------------------------------------------------------


class _Sets:
    """The sets of one group as numbers of their distinct shingles."""

    def __init__(self, values: list[np.ndarray]):
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        shingles, self.flat = np.unique(np.concatenate(values), return_inverse=True)
        self.mark = np.zeros(len(shingles), bool)

    def linked(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others (rows in ascending order) share enough with one."""
        small, large = np.minimum(self.sizes[others], self.sizes[one]), np.maximum(self.sizes[others], self.sizes[one])
        fits = np.flatnonzero(100 * small >= percent * large)
        out = np.zeros(len(others), bool)
        if not len(fits):
            return out
        rows = others[fits]
        own = self.flat[self.starts[one] : self.starts[one + 1]]
        self.mark[own] = True
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        shared = np.add.reduceat(self.mark[self.flat[take]], ends - sizes, dtype=np.int64)
        self.mark[own] = False
        out[fits] = 100 * shared >= percent * (sizes + self.sizes[one] - shared)
        return out


def set_ties(values: list[np.ndarray], nodes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(node, smallest node reached) over all links among the members of a block."""
    order = np.argsort(nodes, kind="stable")
    sets, nodes = _Sets([values[i] for i in order]), nodes[order]
    left = np.arange(len(nodes))
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = sets.linked(front.pop(), left, percent)
            reached, left = left[near], left[~near]
            front.extend(reached.tolist())
            out += [(n, int(nodes[root])) for n in nodes[reached].tolist()]
    return out


def cross_ties(values: list[np.ndarray], nodes: np.ndarray, rest: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Ties that connect what the links between members marked ``rest`` and all members connect."""
    sets = _Sets(values)
    up = list(range(len(nodes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    everyone = np.arange(len(nodes))
    for one in np.flatnonzero(rest).tolist():
        for other in np.flatnonzero(sets.linked(one, everyone, percent)).tolist():
            a, b = top(one), top(other)
            if a != b:
                up[a] = b
                out.append((max(nodes[one], nodes[other]).item(), min(nodes[one], nodes[other]).item()))
    return out


def _decoded(members: pa.ListArray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(sets, nodes, marks) of each group of structs (node, mark, set)."""
    at, inner = members.offsets.to_numpy(), members.values
    nodes, marks, sets = (inner.field(i) for i in range(3))
    nodes, marks = nodes.to_numpy(), marks.to_numpy(zero_copy_only=False)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values = [np.frombuffer(sets[i].as_buffer(), np.uint64) for i in range(a, b)]
        yield values, nodes[a:b], marks[a:b]


def _tie_batches(ties) -> Iterator[pa.RecordBatch]:
    pairs = np.array(list(set(ties)), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidate_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(group, blocks, block, node, set): hashes of each set, read from the texts.

    ``members`` holds (node, id, text_hash, k1, group, blocks): the node, a row that has its set, the
    name of the set, and the node's candidate group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("k1").to_numpy()
            for first, last, data, bounds in byte_slices(batch.column("text")):
                flat, at = shingle_sets(data, bounds, shingle)
                right = np.flatnonzero((_set_keys(flat, at)[0] == wanted[first:last]) & (np.diff(at) > 0))
                raw = [flat[at[i] : at[i + 1]].tobytes() for i in right.tolist()]
                keep = pa.array(first + right)
                arrays = [*(batch.column(c).take(keep) for c in ("group", "blocks", "node")), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "blocks", "node", "set"])

    texts = docs.select(doc_key().alias("id"), text_key().alias("text_hash"), F.col("text").cast("string").alias("text"))
    small = fits_broadcast(members.count(), 56)
    rows = texts.join(F.broadcast(members) if small else members, ["id", "text_hash"]).select("k1", "group", "blocks", "node", "text")
    found = map_texts(rows, run, "group long, blocks int, node long, set binary")
    return found.withColumn("block", F.pmod(F.xxhash64("node", "set"), F.col("blocks")).cast("int"))


def set_links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): ties between nodes, whose components are those of all links inside the candidate groups.

    ``sets`` is stored and has (group, blocks, block, node, set).
    """

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, nodes, _ in _decoded(batch.column(0)):
                yield from _tie_batches(set_ties(values, nodes, percent))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, nodes, rest in _decoded(batch.column(0)):
                yield from _tie_batches(cross_ties(values, nodes, rest, percent))

    several = sets.where("blocks > 1")
    large = written(several.groupBy("group").agg(F.first("blocks").alias("blocks")), "large_groups")
    # A group's number is its smallest node, the pivot, which visits every block.
    visits = several.where("node = group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "set"
    )
    listed = F.collect_list(F.struct("node", F.lit(False).alias("mark"), "set")).alias("members")
    own = sets.select("group", "block", "node", "set").unionByName(visits.select("group", "block", "node", "set"))
    blocks = own.groupBy("group", "block").agg(listed).where(F.size("members") > 1)
    first = written(map_texts(blocks.select("members"), inside, "a long, b long").where("a != b"), "block_ties")
    if large.isEmpty():
        return first.distinct()

    # What isn't tied to the pivot yet meets every block of its group.
    tied = first.join(large, F.col("b") == F.col("group"), "left_semi").select(F.col("a").alias("node")).distinct()
    settled = tied.unionByName(large.select(F.col("group").alias("node")))
    rest = written(several.join(settled, "node", "left_anti"), "rest")
    sizes = rest.groupBy("group").agg(F.ceil(F.sum(F.length("set")) / (8 * block)).cast("int").alias("parts"))
    sizes = written(sizes, "rest_sizes")
    guests = rest.join(sizes, "group").select(
        "group", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(True).alias("mark"), "set",
    )
    hosts = several.join(sizes, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "node", F.lit(False).alias("mark"), "set"
    )
    meetings = guests.unionByName(hosts).groupBy("group", "part", "block").agg(F.collect_list(F.struct("node", "mark", "set")).alias("members"))
    return first.unionByName(map_texts(meetings.select("members"), across, "a long, b long")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest doc_id reached over links with 100 * intersection >= percent *
    union. The signature's threshold suits a ``percent`` of about 85 and more.
    """
    rows = written(signed_documents(docs, shingle).withColumn("_id", doc_key()), "signed")
    sets = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("_id", "text_hash")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")
    )
    nodes = sets.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("first._id").alias("id"), "first.text_hash", "sig", "n")
    nodes = written(nodes, "nodes")
    groups = components(candidate_ties(nodes, bucket)).withColumnRenamed("root", "group")
    members = written(nodes.join(groups, "node").select("node", "id", "text_hash", "k1", "group", "n"), "members")
    blocks = members.groupBy("group").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    large = written(blocks.where("blocks > 1"), "large")
    members = members.join(large, "group", "left").select("node", "id", "text_hash", "k1", "group", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    sets = candidate_sets(docs, written(members, "grouped"), shingle)
    repeated = rows.groupBy("_id", "text_hash").count().where("count > 1")
    sets = written(sets if repeated.isEmpty() else sets.distinct(), "sets")

    roots = components(set_links(sets, percent, block))
    reached = written(nodes.select("node", "id").join(roots, "node"), "reached")
    least = written(reached.groupBy("root").agg(F.min("id").alias("_root")), "least")
    ends = reached.join(least, "root").select("node", "_root")
    named = nodes.join(ends, "node", "left").select("k1", "k2", F.coalesce("_root", "id").alias("_root"))
    out = rows.join(written(named, "roots"), ["k1", "k2"], "left").withColumn("_root", F.coalesce("_root", "_id"))
    return out.select(
        "doc_id", "n_shingles", back_to_null("_root").alias("component_id"), (F.col("_id") == F.col("_root")).alias("kept")
    )
