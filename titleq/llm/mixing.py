"""Language-model scores by logistic context mixing over bits.

A text is its lower-cased (A-Z) words and an end mark; a word is its bytes and a blank, the end mark
a blank alone. Every byte is predicted bit by bit. Four hashed contexts, of the last one, two and
three bytes in the word and of the whole word so far, each keep how often a 0 and a 1 followed; their
log odds are the inputs of a logistic mixer whose weights are chosen by a gate (how well the longer
contexts are known). The mixed probability is refined by a table of what really followed at each
level of probability (adaptive map). The total over all bits is the text's probability.

All contexts belong to the text's class. Classes are the languages of a bounded sample of training
texts; a text is scored in the class that its frequent words fit best, which costs the logarithm of
the number of classes. So a score never exceeds what a mixture of the classes would give.

Training, over all training texts: words are counted per class by Spark, grouped, and kept in blocks
of sorted words. The whole-word context counts every training word exactly: words that share a
prefix are neighbours, so a block sums its own, and prefixes of its first and last words, the only
ones that other blocks can share, are summed over blocks by Spark. The contexts of one to three bytes
are summed in hashed tables with at least twice as many slots as there are distinct contexts, by a
count from a 64th of the hashes. The mixer learns online in each task, chunk by chunk by
steps scaled with the curvature so far, over the bits of all distinct words weighted by their counts,
with the occurrence itself left out of its contexts; tasks' weights are averaged and maps summed. A word's probability in its class depends on nothing but
the word, so it is computed once per distinct word. Frequent words (``HEAD``) are sent to the tasks
that read texts; the others meet their words by a shuffled join, in which none is frequent.

A null or empty text is an end mark alone. Without training texts every bit has probability one half.
Ties of classes go to the first by name. Repeated rows each count in training and get equal scores;
a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, byte_slices, list_array, map_texts, run_hashes, splitmix, written

#: Texts per class, words per class and classes (the most frequent) of the class chooser.
CLASS_ROWS, CLASS_WORDS, CLASSES = 2000, 2000, 16
#: Least slots of the tables of the contexts of one, two and three bytes.
SLOTS = (1 << 19, 1 << 20, 1 << 21)
HEAD = 1 << 16
#: Distinct words that a task counts before it hands them on, and entries of a block, learned from at once.
COUNTED = 1 << 18
CHUNK = 4096
#: What the adaptive map keeps of its sums for each further chunk.
FADING = 0.95
GATES = 6 * 4 * 3
LEVELS = 33
INPUTS = len(SLOTS) + 2
PREFIX_BASE = 0x8CB92BA72F3D8DD7
GOLD = np.uint64(0x9E3779B97F4A7C15)
LEAST = 2.0**-18


# --- classes ------------------------------------------------------------------------------------


class ClassChooser:
    """Chooses the class whose frequent words fit a text best."""

    def __init__(self, counts: dict[str, Counter]):
        self.names = sorted(counts) or ["all"]
        words = sorted({w for c in counts.values() for w, _ in c.most_common(CLASS_WORDS)})
        self.place = {w: i for i, w in enumerate(words, 1)}  # from 1, so that a place is never false
        table = np.array([[counts[n][w] for n in self.names] for w in words], float).reshape(-1, len(self.names))
        totals = np.array([sum(counts[n].values()) if counts else 0 for n in self.names], float)
        logs = np.log((table + 0.5) / (totals + 0.5 * (len(words) + 1)))
        self.logs = np.vstack([np.zeros((1, len(self.names))), logs])

    def __call__(self, words: list[bytes]) -> int:
        if len(self.names) == 1:
            return 0
        found = np.fromiter(filter(None, map(self.place.get, words)), np.int64)
        return int(np.argmax(self.logs[found].sum(axis=0))) if len(found) else 0


def choose_classes(docs: DataFrame, training: Column) -> ClassChooser:
    known = docs.where(training & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES)
    share = F.least(F.lit(1.0), F.lit(float(CLASS_ROWS)) / F.col("n"))
    sample = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update((text or "").encode().lower().split())
        for lang, own in counts.items():
            top = own.most_common(4 * CLASS_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(top)), pa.array([w.decode() for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                names=["lang", "word", "n"],
            )

    counts: dict[str, Counter] = {}
    for r in sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], Counter())[r["word"].encode()] = r["n"]
    return ClassChooser(counts)


# --- words --------------------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for _, _, data, bounds in byte_slices(column):
        raw = data.tobytes().lower()
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield raw[a:b].split()


def count_words(docs: DataFrame, training: Column, chooser: ClassChooser) -> DataFrame:
    """(token, c, n, classes, counts): training and all occurrences of each token (end mark: empty),
    the classes in which it occurs and its training occurrences in each."""
    sent = docs.sparkSession.sparkContext.broadcast(chooser)

    def rows(counts: dict[int, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for kind, (learned, other) in counts.items():
            tokens = list(learned.keys() | other.keys())
            for i in range(0, len(tokens), 50_000):
                part = tokens[i : i + 50_000]
                c = np.fromiter((learned[t] for t in part), np.int64, len(part))
                n = c + np.fromiter((other[t] for t in part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()).cast(pa.string()), pa.array(np.full(len(part), kind, np.int32)), pa.array(c), pa.array(n)],
                    names=["token", "class", "c", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[Counter, Counter]] = {}
        for batch in batches:
            for learn, words in zip(batch.column(1).to_pylist(), _texts(batch.column(0))):
                own = counts.setdefault(sent.value(words), (Counter(), Counter()))[0 if learn else 1]
                own.update(words)
                own[b""] += 1
            if sum(len(a) + len(b) for a, b in counts.values()) > COUNTED:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)

    counted = docs.select(F.col("text").cast("string").alias("text"), training.alias("learn")).mapInArrow(run, "token string, class int, c long, n long")
    by_class = counted.groupBy("token", "class").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    by_token = by_class.groupBy("token").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("class", "c"))).alias("own")
    )
    return by_token.select("token", "c", "n", F.col("own.class").alias("classes"), F.col("own.c").alias("counts"))


class Words:
    """A batch's words (one entry per class in which they occur) as bits that no other entry repeats.

    Entries are ordered by class and word; bytes that an entry shares with the one before it are
    computed once.
    """

    def __init__(self, tokens: list[bytes], kind: np.ndarray, slots: tuple[int, ...] = SLOTS):
        self.n = len(tokens)
        data = b" ".join(tokens) + b" "
        byte = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, self.n) + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word = np.repeat(np.arange(self.n), sizes)
        at = np.arange(len(byte)) - starts[word]
        # Bytes equal to those of the entry before, from the start on.
        before = np.maximum(starts[word] - sizes[np.maximum(word - 1, 0)], 0) + at
        same = (word > 0) & (at < sizes[np.maximum(word - 1, 0)]) & (byte[np.minimum(before, len(byte) - 1)] == byte)
        same &= kind[word] == kind[np.maximum(word - 1, 0)]
        shared = np.minimum.reduceat(np.where(same, sizes[word], at), starts)
        own = at >= shared[word]
        self.shared, self.word = shared, word[own]
        self.counts = np.bincount(self.word, minlength=self.n)
        # Context hashes before each byte.
        tag = splitmix((kind[word].astype(np.uint64) + np.uint64(1)) * GOLD)
        rolled = np.zeros(len(byte), np.uint64)
        hashes = []
        for back in (1, 2, 3):
            previous = np.zeros(len(byte), np.uint64)
            previous[back:] = byte[: len(byte) - back].astype(np.uint64) + np.uint64(1)
            previous[at < back] = 0
            rolled = rolled * np.uint64(257) + previous
            hashes.append(splitmix(rolled[own] * GOLD + np.uint64(back)) ^ tag[own])
        flat = np.flatnonzero(own)
        self.prefix = run_hashes(BYTE_CODE[byte], starts[self.word], flat, PREFIX_BASE) ^ tag[own]
        value = byte[own].astype(np.int64)[:, None]
        step = np.arange(8)
        node = (1 << step | value >> (8 - step)).astype(np.uint64)
        self.bits = (value >> (7 - step) & 1).astype(bool)
        self.node = node.astype(np.int64)
        self.whole = splitmix(self.prefix[:, None] + node * GOLD)
        self.keys = [splitmix(h[:, None] + node * GOLD) for h in hashes]
        firsts = np.cumsum([0, *slots])
        self.slots = [(k & np.uint64(s - 1)).astype(np.int64) + a for k, s, a in zip(self.keys, slots, firsts)]

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """For each computed byte, the counts of all entries that share it."""
        sums = np.concatenate([[0], np.cumsum(counts)])
        firsts = np.cumsum(self.counts) - self.counts
        until = np.full(len(self.word), self.n)
        stack: list[int] = []
        for i, (depth, first, own) in enumerate(zip(self.shared.tolist(), firsts.tolist(), self.counts.tolist())):
            if len(stack) > depth:
                until[stack[depth:]] = i
                del stack[depth:]
            stack.extend(range(first, first + own))
        return sums[until] - sums[self.word]

    def totals(self, cost: np.ndarray) -> np.ndarray:
        """Sum over each entry's bytes of the costs of computed bytes."""
        out = np.zeros(self.n)
        firsts = (np.cumsum(self.counts) - self.counts).tolist()
        costs = cost.tolist()
        stack = [0.0]
        for i, (depth, first, own) in enumerate(zip(self.shared.tolist(), firsts, self.counts.tolist())):
            del stack[depth + 1 :]
            total = stack[-1]
            for x in costs[first : first + own]:
                total += x
                stack.append(total)
            out[i] = total
        return out


def _entries(tokens: pa.Array, classes: pa.Array, counts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, classes, training counts, rows) of a block's words, by class and word."""
    sizes = np.diff(classes.offsets.to_numpy())
    row = np.repeat(np.arange(len(tokens)), sizes)
    kind = classes.flatten().to_numpy().astype(np.int64)
    order = np.lexsort((row, kind))
    row = row[order]
    words = np.array(tokens.cast(pa.binary()).to_pylist(), object)
    return words[row].tolist(), kind[order], counts.flatten().to_numpy()[order], row


def _pieces(words: list[bytes], classes: list[int], size: int) -> Iterator[slice]:
    """Slices of about ``size`` entries (words times their classes) and 32 bytes for each, or one long word."""
    i = 0
    while i < len(words):
        j, entries, weight = i, 0, 0
        while j < len(words) and entries < size and weight <= 32 * size:
            entries += classes[j]
            weight += len(words[j]) * classes[j]
            j += 1
        yield slice(i, j)
        i = j


# --- the model ----------------------------------------------------------------------------------

SPLITS = np.cumsum([0, *SLOTS])


def word_blocks(words: DataFrame) -> DataFrame:
    """(block, tokens, c, n, classes, counts): runs of sorted words with about ``CHUNK`` entries, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            classes = np.diff(batch.column(3).offsets.to_numpy()).tolist()
            for cut in _pieces(batch.column(0).cast(pa.binary()).to_pylist(), classes, CHUNK):
                part = batch.slice(cut.start, cut.stop - cut.start)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", "tokens", "c", "n", "classes", "counts"])
                block += 1

    by_word = words.select("token", "c", "n", "classes", "counts").repartitionByRange("token").sortWithinPartitions("token")
    return map_texts(
        by_word, run, "block long, tokens array<string>, c array<long>, n array<long>, classes array<array<int>>, counts array<array<long>>"
    )


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
    """Each block of a batch: its arrays by name."""
    for i in range(batch.num_rows):
        yield {n: getattr(c[i], "values", c[i]) for n, c in zip(batch.schema.names, batch.columns)}


#: One in so many hashes of contexts is counted to size their tables.
SAMPLED = 64


def _found_contexts(blocks: DataFrame) -> DataFrame:
    """(order, block, key, zeros, ones): sampled keys of short contexts (order 0 to 2), and (order 3)
    a block's sums of the whole-word contexts that are prefixes of its first or last word of a class.

    Blocks are runs of sorted words, so no other prefix occurs in two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                tokens, kind, count, _ = _entries(r["tokens"], r["classes"], r["counts"])
                own = Words(tokens, kind)
                ends = np.flatnonzero(np.diff(kind, prepend=-1, append=-1))
                ends = np.unique(np.concatenate([ends[:-1], ends[1:] - 1]))
                edge = np.isin(own.prefix, Words([tokens[i] for i in ends], kind[ends]).prefix)
                keys, tally, _ = _tally(own.whole[edge], own.bits[edge], own.weights(count)[edge])
                parts = [(3, keys, tally[0], tally[1])]
                for k, all_ in enumerate(own.keys):
                    some = np.unique(all_[all_ >> np.uint64(32) & np.uint64(SAMPLED - 1) == 0])
                    parts.append((k, some, np.zeros(len(some)), np.zeros(len(some))))
                for k, keys, zeros, ones in parts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), r["block"].as_py())),
                            pa.array(keys.view(np.int64)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)),
                        ],
                        names=["order", "block", "key", "zeros", "ones"],
                    )

    return map_texts(
        blocks.select("block", "tokens", "classes", "counts"), run, "order int, block long, key long, zeros long, ones long"
    )


def _tally(keys: np.ndarray, bits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, weight of their 0 and 1 bits, place of each bit's key among them)."""
    distinct, at = np.unique(keys, return_inverse=True)
    at = at.reshape(keys.shape)
    mass = np.broadcast_to(weight[:, None], keys.shape)
    tally = np.array([np.bincount(at[bits == bit], mass[bits == bit], len(distinct)) for bit in (False, True)])
    return distinct, tally, at


def with_shared(blocks: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """(blocks with the sums of the contexts that they share with others, slots of the tables)."""
    found = written(_found_contexts(blocks), "word_contexts")
    counted = found.where("order < 3").groupBy("order").agg(F.count_distinct("key").alias("n")).collect()
    slots = list(SLOTS)
    for r in counted:
        while slots[r["order"]] < 2 * SAMPLED * r["n"]:
            slots[r["order"]] *= 2
    sums = found.where("order = 3").groupBy("key").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.collect_list("block").alias("blocks")
    )
    shared = sums.where(F.size("blocks") > 1).select("key", "zeros", "ones", F.explode("blocks").alias("block"))
    lists = shared.groupBy("block").agg(F.collect_list(F.struct("key", "zeros", "ones")).alias("s"))
    out = blocks.join(lists, "block", "left").select(
        *blocks.columns, *[F.coalesce(F.col(f"s.{c}"), F.array().cast("array<long>")).alias(c) for c in ("key", "zeros", "ones")]
    )
    return written(out, "word_blocks_shared"), tuple(slots)


def whole_counts(own: Words, count: np.ndarray, shared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How often a 0 and a 1 followed the whole-word context of each bit, over all training words."""
    distinct, tally, at = _tally(own.whole, own.bits, own.weights(count))
    keys, zeros, ones = shared
    tally[:, np.searchsorted(distinct, keys.view(np.uint64))] = zeros, ones
    return tally[0][at], tally[1][at]


def _read_block(r: dict[str, pa.Array], slots: tuple[int, ...]) -> tuple[Words, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(words, training counts, whole-word counts, classes, rows) of a block."""
    tokens, kind, count, row = _entries(r["tokens"], r["classes"], r["counts"])
    own = Words(tokens, kind, slots)
    shared = tuple(r[n].to_numpy() for n in ("key", "zeros", "ones"))
    return own, count, whole_counts(own, count, shared), kind, row


def context_tables(blocks: DataFrame, sizes: tuple[int, ...]) -> np.ndarray:
    """(2, all slots): how often a 0 and a 1 followed each context of one to three bytes.

    Tasks sum first; a shuffle sums per slot, and there are at most as many slots as the tables hold.
    """
    whole = sum(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, whole))
        for batch in batches:
            for r in _rows(batch):
                tokens, kind, count, _ = _entries(r["tokens"], r["classes"], r["counts"])
                own = Words(tokens, kind, sizes)
                weight = own.weights(count)
                for slots in own.slots:
                    w = np.broadcast_to(weight[:, None], slots.shape)
                    for bit in (0, 1):
                        chosen = own.bits == bit
                        np.add.at(table[bit], slots[chosen], w[chosen])
        at = np.flatnonzero(table.any(axis=0))
        for i in range(0, len(at), 1 << 18):
            part = at[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(table[0, part].astype(np.int64)), pa.array(table[1, part].astype(np.int64))],
                names=["slot", "zeros", "ones"],
            )

    summed = map_texts(blocks.select("tokens", "classes", "counts"), run, "slot long, zeros long, ones long")
    got = summed.groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    out = np.zeros((2, whole), np.float32)
    slot = got.column("slot").to_numpy()
    out[0, slot], out[1, slot] = got.column("zeros").to_numpy(), got.column("ones").to_numpy()
    return out


def _bucket(n: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges, np.float32), n.ravel(), "right").reshape(n.shape)


def inputs(
    words: Words, tables: np.ndarray, leave_out: bool, whole: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of the mixer, gate) of each bit; ``leave_out`` takes one occurrence from its contexts.

    ``whole`` are the counts of the whole-word contexts; without it, none was seen.
    """
    shape = words.bits.shape
    x = np.empty((INPUTS, *shape), np.float32)
    seen = []
    none = np.zeros(shape, np.float32)
    for k, (zeros, ones) in enumerate([*((tables[0][s], tables[1][s]) for s in words.slots), whole or (none, none)]):
        if leave_out:
            ones = np.maximum(ones - words.bits, 0)
            zeros = np.maximum(zeros - ~words.bits, 0)
        x[k] = np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))
        seen.append(zeros + ones)
    x[-1] = 0.3
    gate = _bucket(seen[3], (1, 2, 4, 16, 256)) * 12 + _bucket(seen[2], (1, 8, 128)) * 3 + _bucket(seen[1], (16, 512))
    return x, gate


def mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of a 1."""
    return np.clip(np.einsum("kij,ijk->ij", x, weights[gate]), -12, 12)


def _level(odds: np.ndarray) -> np.ndarray:
    return np.rint((odds + 12) / 24 * (LEVELS - 1)).astype(np.int64)


def refined(odds: np.ndarray, gate: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Probability of a 1, halfway between the mixer and what followed at its level."""
    p = 1 / (1 + np.exp(-odds))
    zeros, ones = seen[:, gate, _level(odds)]
    return np.clip((p + (ones + 50 * p) / (zeros + ones + 50)) / 2, LEAST, 1 - LEAST)


def learn_mixer(blocks: DataFrame, tables, slots: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(weights of each gate, adaptive map): online in each task, then averaged and summed.

    The map, (2, gates, levels), holds what followed at each level of the task's own mixer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.full((GATES, INPUTS), 0.25)
        bend = np.tile(100 * np.eye(INPUTS), (GATES, 1, 1))
        seen = np.zeros((2, GATES, LEVELS))
        known = np.zeros(GATES)
        for batch in batches:
            for r in _rows(batch):
                own, count, whole, _, _ = _read_block(r, slots)
                x, gate = inputs(own, tables.value, True, whole)
                odds = mixed(x, gate, weights)
                mass = np.broadcast_to(own.weights(count)[:, None], gate.shape).ravel().astype(float)
                flat, bits, x = gate.ravel(), own.bits.ravel(), x.reshape(INPUTS, -1)
                seen *= FADING
                for bit in (0, 1):
                    place = flat[bits == bit] * LEVELS + _level(odds).ravel()[bits == bit]
                    seen[bit] += np.bincount(place, mass[bits == bit], GATES * LEVELS).reshape(GATES, LEVELS)
                p = 1 / (1 + np.exp(-odds.ravel()))
                slope = np.stack([np.bincount(flat, (bits - p) * mass * x[k], GATES) for k in range(INPUTS)], axis=1)
                for j in range(INPUTS):
                    for k in range(j + 1):
                        bend[:, j, k] += (more := np.bincount(flat, p * (1 - p) * mass * x[j] * x[k], GATES))
                        if j != k:
                            bend[:, k, j] += more
                weights += np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -0.5, 0.5)
                known += np.bincount(flat, mass, GATES)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([weights.ravel(), known, seen.ravel()]).tobytes()], pa.binary())], names=["state"])

    weights, known, seen = np.zeros((GATES, INPUTS)), np.zeros(GATES), np.zeros((2, GATES, LEVELS))
    # One state of 50 kB for each task; at most 256 tasks read the distinct words.
    read = blocks.select("tokens", "classes", "counts", "key", "zeros", "ones").coalesce(256)
    for r in map_texts(read, run, "state binary").toLocalIterator():
        state = np.frombuffer(r["state"])
        own = state[GATES * INPUTS : GATES * INPUTS + GATES]
        weights += state[: GATES * INPUTS].reshape(GATES, INPUTS) * own[:, None]
        known += own
        seen += state[GATES * INPUTS + GATES :].reshape(seen.shape)
    return np.where(known[:, None] > 0, weights / np.maximum(known, 1)[:, None], 0.25), seen


def score_words(blocks: DataFrame, tables, slots: tuple[int, ...], weights: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(token, c, n, classes, logs): log10 probability of each token in each of its classes."""
    sent = blocks.sparkSession.sparkContext.broadcast((weights, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = sent.value
        for batch in batches:
            for r in _rows(batch):
                own, _, whole, kind, row = _read_block(r, slots)
                x, gate = inputs(own, tables.value, False, whole)
                p = refined(mixed(x, gate, weights), gate, seen)
                logs = own.totals(np.log10(np.where(own.bits, p, 1 - p)).sum(axis=1))
                order = np.lexsort((kind, row))
                sizes = np.diff(r["classes"].offsets.to_numpy())
                lists = list_array(pa.array(kind[order].astype(np.int32)), sizes), list_array(pa.array(logs[order]), sizes)
                yield pa.RecordBatch.from_arrays([r["tokens"], r["c"], r["n"], *lists], names=["token", "c", "n", "classes", "logs"])

    return map_texts(
        blocks.select("tokens", "c", "n", "classes", "counts", "key", "zeros", "ones"), run,
        "token string, c long, n long, classes array<int>, logs array<double>",
    )


# --- texts --------------------------------------------------------------------------------------

_READ = (
    "row long, doc_id {kind}, held_out boolean, class int, n_bytes long, n_tokens long, n_known long, base double, "
    "log double, tail array<string>, times array<long>"
)


def read_texts(docs: DataFrame, held_out: Column, chooser: ClassChooser, head: pa.Table) -> DataFrame:
    """One row per text: sums over its frequent words, and its other words with their numbers."""
    place = {t: i for i, t in enumerate(head.column("token").cast(pa.binary()).to_pylist())}
    c = head.column("c").to_numpy()
    kinds = head.column("classes").combine_chunks()
    row = np.repeat(np.arange(len(kinds)), np.diff(kinds.offsets.to_numpy()))
    logs = np.zeros((len(kinds), len(chooser.names)))
    logs[row, kinds.flatten().to_numpy()] = head.column("logs").combine_chunks().flatten().to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((chooser, place, np.append(np.log10(c + 1), 0), np.append(c > 0, False), np.vstack([logs, np.zeros((1, logs.shape[1]))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser, place, base, known, logs = sent.value
        number = TaskContext.get().partitionId() << 40
        none = len(place)
        for batch in batches:
            done = 0
            for first, last, data, bounds in byte_slices(batch.column(2)):
                raw = data.tobytes().lower()
                rows = []
                for k in range(last - first):
                    words = raw[bounds[k] : bounds[k + 1]].split()
                    kind = chooser(words)
                    words.append(b"")
                    at = np.fromiter(map(place.get, words, repeat(none)), np.int64, len(words))
                    tail = Counter([words[i] for i in np.flatnonzero(at == none).tolist()])
                    rows.append((
                        number, kind, int(bounds[k + 1] - bounds[k]), len(words), int(known[at].sum()), float(base[at].sum()),
                        float(logs[at, kind].sum()), [w.decode() for w in tail], list(tail.values()),
                    ))
                    number += 1
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                arrays = [pa.array(x, t) for x, t in zip(cols, kinds)]
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [arrays[0], own.column(0), own.column(1), *arrays[1:]],
                    names=["row", "doc_id", "held_out", "class", "n_bytes", "n_tokens", "n_known", "base", "log", "tail", "times"],
                )
                done = last
            assert done == batch.num_rows

    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _READ.format(kind=dict(docs.dtypes)["doc_id"])
    )


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Learns from the rows of ``docs`` (text, lang) that are not ``held_out`` and scores all.
    """
    spark = docs.sparkSession
    chooser = choose_classes(docs, ~held_out)
    counted = count_words(docs, ~held_out, chooser)
    blocks = written(word_blocks(counted), "word_blocks")
    total, distinct = blocks.select(F.explode("c").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    blocks, slots = with_shared(blocks)
    tables = spark.sparkContext.broadcast(context_tables(blocks, slots))
    weights, seen = learn_mixer(blocks, tables, slots)
    logs = written(score_words(blocks, tables, slots, weights, seen), "word_scores")

    head = logs.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "c", "classes", "logs").toArrow()
    read = written(read_texts(docs, held_out, chooser, head), "text_sums")
    tail = read.select("row", "class", F.explode(F.arrays_zip("tail", "times")).alias("w")).select(
        "row", "class", F.col("w.tail").alias("token"), F.col("w.times").alias("times")
    )
    met = tail.join(logs.select("token", "c", "classes", "logs"), "token")
    own = F.element_at("logs", F.array_position("classes", F.col("class")).cast("int"))
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"),
        F.sum(F.col("times") * own).alias("more_log"),
    )
    space = log10(total + distinct + 1)
    found = read.drop("tail", "times").join(rest, "row", "left")
    score = F.col("log") + F.coalesce("more_log", F.lit(0.0)) - log10(len(chooser.names))
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
        score.alias("score"),
        (-score / log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
