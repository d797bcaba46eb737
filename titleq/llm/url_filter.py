"""URL filter: rules by host and path, and a ratio of character language models for the rest.

Rules judge the URLs that they fit. The URLs allowed and those blocked by a rule train two
variable-order Markov models over bytes: the probability of a byte after its last ``ORDER`` bytes is
smoothed with that after one byte less, down to the uniform one, each context weighing as much as it
has been seen. Sightings are counted exactly by Spark, by 64-bit hashes of contexts; models are sent to the
tasks as open hash tables that keep the hashes, at most half full, and grow with the distinct contexts.
A URL that no rule fits is judged by the difference of its log-likelihoods per byte against a
threshold: where the error shares of both classes are equal on a fifth of the ruled URLs that a
first pair of models has not seen. The final pair is trained on all of them.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
up to ``?``, ``#`` or the end. Without ``://``, or for a null url, both are empty and no rule fits.
An empty or null url is blocked. If one class has no ruled URL, the difference and the threshold
are zero and URLs without a rule are allowed. Equal urls get equal verdicts; other columns are
ignored. Of rules that fit, the longest (host and path together) wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_texts, splitmix, written

#: (verdict, host, path): fixed values of the task.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
ORDER = 5
CELLS = 1 << 15
#: Weight of a context's shorter one, in sightings.
PRIOR = 4.0
BINS = 2048
SPAN = 8.0
FOLDS = 5
#: Distinct contexts of one order that a task holds before it hands them on.
HELD = 1 << 18


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, where, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)[::-1]:
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(below)
        name = F.when(fits, F.lit(where + below)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


class Places:
    """Numbers distinct 64-bit hashes from 0; a hash that is not among them has the number after the last."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, len(keys), np.int32)
        self.none = len(keys)
        left, cell = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.number[cell] == self.none
            at, one = np.unique(cell[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.keys[at], self.number[at] = keys[left[one]], left[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, cell = left[rest], (cell[rest] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        cell = self._first(keys)
        out = self.number[cell]
        left = np.flatnonzero((out != self.none) & (self.keys[cell] != keys))
        cell = cell[left]
        while len(left):
            cell = (cell + 1) & ((1 << self.bits) - 1)
            out[left] = self.number[cell]
            on = (out[left] != self.none) & (self.keys[cell] != keys[left])
            left, cell = left[on], cell[on]
        return out


def hashes(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0: (hash of the context, hash of context and byte) at every byte.

    Where fewer bytes stand before a byte in its row, they and the row's start are the context.
    """
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    byte = data.astype(np.uint64) + np.uint64(1)
    rolled = np.zeros(len(data), np.uint64)
    for order in range(ORDER + 1):
        if order:
            previous = np.zeros(len(data), np.uint64)
            previous[order:] = byte[: len(data) - order]
            previous[at < order] = 0
            rolled = rolled * np.uint64(0x100000001B3) + previous + np.uint64(1)
        context = splitmix(rolled)
        yield context, splitmix(context + byte)


def contexts(data: np.ndarray, bounds: np.ndarray, places: list[tuple[Places, Places]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (number of the context, number of context and byte) at every byte.

    ``places`` number the hashes of each order; without them, numbers are hashes modulo ``CELLS``.
    """
    for order, found in enumerate(hashes(data, bounds)):
        if places is None:
            yield tuple((h & np.uint64(CELLS - 1)).astype(np.int64) for h in found)
        else:
            yield tuple(p(h) for p, h in zip(places[order], found))


def log_likelihoods(data: np.ndarray, bounds: np.ndarray, tables, numbers: list | None = None) -> np.ndarray:
    """Natural log-probability of each row; ``tables`` has for each order the counts of contexts and of sightings.

    ``numbers`` are those of ``contexts``.
    """
    p = np.full(len(data), 1 / 256)
    for (context, seen), (all_, own) in zip(numbers or contexts(data, bounds), tables):
        p = (np.minimum(own[seen], all_[context]) + PRIOR * p) / (all_[context] + PRIOR)
    sums = np.concatenate([[0.0], np.cumsum(np.log(p))])
    return sums[bounds[1:]] - sums[bounds[:-1]]


#: (places of each order, for each class and order the counts of contexts and of sightings)
Models = tuple[list[tuple[Places, Places]], list[list[tuple[np.ndarray, np.ndarray]]]]


def difference(data: np.ndarray, bounds: np.ndarray, models: Models) -> np.ndarray:
    """Log-likelihood of accepted less that of rejected, per byte."""
    places, (rejected, accepted) = models
    numbers = list(contexts(data, bounds, places))
    sizes = np.maximum(np.diff(bounds), 1)
    return (log_likelihoods(data, bounds, accepted, numbers) - log_likelihoods(data, bounds, rejected, numbers)) / sizes


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums, (groups, keys)."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts, axis=1)
    return distinct, np.array([np.bincount(at, c, len(distinct)) for c in every]).astype(np.int64)


def count_contexts(ruled: DataFrame) -> DataFrame:
    """(part, key, n0, n1, n2, n3): exact counts of each context and sighting over all rows (url, accepted, side).

    ``part`` is twice the order, and one more for sightings; n0 to n3 count rejected and accepted URLs
    of side 0, then those of side 1. Tasks sum first, a shuffle sums per key.
    """

    def rows(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        names = ["part", "key", "n0", "n1", "n2", "n3"]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            side = batch.column(2).to_numpy()
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for first, last, data, bounds in byte_slices(batch.column(0)):
                group = np.repeat(2 * side[first:last] + accepted[first:last], np.diff(bounds))
                ones = (group == np.arange(4)[:, None]).astype(np.int64)
                for order, pair in enumerate(hashes(data, bounds)):
                    for part, found in enumerate(pair, 2 * order):
                        keys, counts = _summed([found], [ones])
                        if part in held:
                            keys, counts = _summed([held[part][0], keys], [held[part][1], counts])
                        held[part] = keys, counts
                        if len(keys) > HELD:
                            yield rows(part, *held.pop(part))
        for part, (keys, counts) in held.items():
            yield rows(part, keys, counts)

    found = map_texts(ruled.select("url", "accepted", "side"), run, "part int, key long, n0 long, n1 long, n2 long, n3 long")
    return found.groupBy("part", "key").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(4)])


def _models(ruled: DataFrame) -> tuple[Models, Models]:
    """Models of the rows of side 0, and of all rows."""
    got = count_contexts(ruled).toArrow()
    part, key = got.column("part").to_numpy(), got.column("key").to_numpy().view(np.uint64)
    n = np.array([got.column(f"n{g}").to_numpy() for g in range(4)])
    places, first, all_ = [], ([], []), ([], [])
    for order in range(ORDER + 1):
        own = [np.flatnonzero(part == 2 * order + k) for k in (0, 1)]
        places.append(tuple(Places(key[at]) for at in own))
        for kind in (0, 1):
            for out, counts in ((first, n[kind]), (all_, n[kind] + n[kind + 2])):
                out[kind].append(tuple(np.append(counts[at], 0).astype(np.float64) for at in own))
    return (places, list(first)), (places, list(all_))


def _threshold(ruled: DataFrame, models: Models) -> float:
    """Where both classes of the first fold have equal error shares; 0 if one is missing."""
    sent = ruled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, BINS), np.int64)
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for first, last, data, bounds in byte_slices(batch.column(0)):
                value = difference(data, bounds, sent.value)
                place = np.clip(((value / SPAN + 0.5) * BINS).astype(int), 0, BINS - 1)
                for kind in (0, 1):
                    tally[kind] += np.bincount(place[accepted[first:last] == kind], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([tally.tobytes()], pa.binary())], names=["tally"])

    rows = ruled.where("side = 1").select("url", "accepted").coalesce(64).mapInArrow(run, "tally binary").collect()
    tally = sum((np.frombuffer(r["tally"], np.int64).reshape(2, BINS) for r in rows), np.zeros((2, BINS), np.int64))
    if not tally.sum(axis=1).all():
        return 0.0
    blocked_right = np.cumsum(tally[0]) / tally[0].sum()
    allowed_wrong = np.cumsum(tally[1]) / tally[1].sum()
    gap = np.abs((1 - blocked_right) - allowed_wrong)
    best = np.flatnonzero(gap == gap.min())
    return float(((best[0] + best[-1]) / 2 + 1) / BINS - 0.5) * SPAN


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) of every row of ``pages``."""
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    judged = parsed.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    side = (F.crc32(F.col("url").cast("binary")) % FOLDS == 0).cast("int")
    ruled = written(
        judged.where("verdict is not null").select("url", (F.col("verdict") == "allow").alias("accepted"), side.alias("side")), "ruled_urls"
    )
    first, both = _models(ruled)
    learned = all(tables[0][0].any() for tables in both[1])
    threshold = _threshold(ruled, first) if learned else 0.0
    sent = pages.sparkSession.sparkContext.broadcast(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(1)):
                own = batch.slice(first, last - first)
                value = difference(data, bounds, sent.value) if learned else np.zeros(last - first)
                method = np.where((value >= threshold) & (np.diff(bounds) > 0), "allow", "block")
                given = own.column(5).to_pylist()
                final = pa.array([g or m for g, m in zip(given, method.tolist())], pa.string())
                arrays = [own.column(0), *(own.column(i) for i in (2, 3, 4)), final, pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "rule", "verdict", "difference"])

    kind = dict(pages.dtypes)["page_id"]
    return judged.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, difference double")
