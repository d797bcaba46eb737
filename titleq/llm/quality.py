"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A text becomes a vector of statistics of its characters, words and lines. Random Fourier features
approximate a Gaussian kernel over the standardised vectors; the ridge scores come from normal
equations that tasks sum over their rows. Each third of the training rows is scored by a model
fitted on the other two (the equations of a model without a third are the sum less that third's),
and an isotonic (pool adjacent violators) curve of the label over those scores turns the scores of
the model of all rows into shares of label 1.

At most about ``FIT_ROWS`` labelled texts are fitted, chosen by a hash of the id; statistics cover
whole texts and are kept by one scan. A null text is empty: its statistics are zero and it is scored
like any other. Rows of labels without a label or a text take no part; a document with several
labels counts once for each. Without any training row all scores are 0.5. Repeated rows get equal
results; a null doc_id has no label and stays null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, list_array, map_texts, remainder, written

FIT_ROWS = 60_000
FOURIER = 256
RIDGE = 1.0
FOLDS = 3
BINS = 512
#: Tasks that sum equations, each of FOLDS matrices.
PARTS = 8
THRESHOLD = 0.7

#: Classes of bytes whose shares are statistics.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?",
    b"|", b"*#$%&", b"{}()[]<>=+-_/\\~^`@", b";:'\"",
]
CLASS_OF = np.zeros(256, np.int64)
for _number, _bytes in enumerate(CLASSES, 1):
    CLASS_OF[list(_bytes)] = _number
CLASS_OF[128:] = len(CLASSES) + 1
WIDTH = len(CLASSES) + 2 + 12


def statistics(raw: bytes) -> np.ndarray:
    """Statistics of one text; zeros for an empty one."""
    out = np.zeros(WIDTH)
    if not raw:
        return out
    n = len(raw)
    shares = np.zeros(len(CLASSES) + 2)
    for i in range(0, n, 1 << 20):
        shares += np.bincount(CLASS_OF[np.frombuffer(raw[i : i + (1 << 20)], np.uint8)], minlength=len(shares))
    out[: len(shares)] = np.sqrt(shares / n)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    own = out[len(shares) :]
    own[0] = np.log1p(n)
    own[1] = np.log1p(len(words))
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = Counter(words)
        own[2], own[3] = np.log1p(sizes.mean()), np.log1p(sizes.std())
        own[4] = len(counts) / len(words)
        own[5] = max(counts.values()) / len(words)
        own[6] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        own[7] = sum(len(w) >= 2 and w[-1:] in b"!|*#$%&" for w in words) / len(words)
        own[8] = np.log1p(sizes.max())
    if lines:
        tally = Counter(lines)
        own[9] = np.log1p(len(lines))
        own[10] = 1 - len(tally) / len(lines)
        own[11] = np.log1p(n / len(lines))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(1)):
                raw = data.tobytes()
                rows = np.array([statistics(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
                stats = list_array(pa.array(rows.ravel()), np.full(len(rows), WIDTH))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), stats], names=["doc_id", "stats"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, WIDTH)


class KernelMap:
    """Standardised statistics and their random Fourier features, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FOURIER) * np.cos(x @ self.waves + self.phases)
        return np.hstack([np.ones((len(x), 1)), x / np.sqrt(WIDTH), waves])


def pool(counts: np.ndarray, hits: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, shares): the rising curve closest to hits / counts, one point per pooled block."""
    blocks: list[list[float]] = []
    for n, h, c in zip(counts, hits, centres):
        if n:
            blocks.append([n, h, n * c])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    points = np.array(blocks)
    return points[:, 2] / points[:, 0], (points[:, 1] + 0.5) / (points[:, 0] + 1)


class QualityModel:
    """Fitted weights and calibration; ``score`` maps statistics to shares of label 1."""

    def __init__(self, features: KernelMap | None, weights: np.ndarray | None, curve: tuple[np.ndarray, np.ndarray] | None):
        self.features, self.weights, self.curve = features, weights, curve

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.features(stats) @ self.weights, *self.curve), 0, 1)


def _sums(rows: DataFrame, features: KernelMap) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of each fold: (FOLDS, p, p) and (FOLDS, p), summed by tasks first."""
    p = 1 + WIDTH + FOURIER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, p, p + 1))
        for batch in batches:
            z, y, fold = features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                total[k, :, :p] += own.T @ own
                total[k, :, p] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((FOLDS, p, p + 1))
    for row in rows.select("stats", "label", "fold").mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    return total[:, :, :p], total[:, :, p]


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    penalty = np.full(len(gram), RIDGE)
    penalty[0] = 1e-6
    return np.linalg.solve(gram + np.diag(penalty), right)


def fit(stats: DataFrame, labels: DataFrame, training: Column, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on rows (doc_id, stats) chosen by ``training`` with labels (doc_id, label 0 or 1)."""
    known = stats.where(training & F.col("doc_id").isNotNull()).join(
        labels.where(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("double").alias("label")), "doc_id"
    ).withColumn("fold", F.floor(remainder(4 * FOLDS) / 4).cast("int"))
    share = fit_rows / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = written(chosen.select("stats", "label", "fold").repartition(PARTS), "labelled_statistics")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, WIDTH))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.stack([np.full(WIDTH, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((3, WIDTH))
    for row in rows.select("stats").mapInArrow(moments, "sums binary").collect():
        total += np.frombuffer(row["sums"]).reshape(3, WIDTH)
    n = total[0, 0]
    if not n:
        return QualityModel(None, None, None)
    mean = total[1] / n
    features = KernelMap(mean, np.sqrt(np.maximum(total[2] / n - mean**2, 1e-6)))
    gram, right = _sums(rows, features)
    without = [_solve(gram.sum(axis=0) - gram[k], right.sum(axis=0) - right[k]) for k in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, BINS))
        for batch in batches:
            z, y, fold = features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.einsum("ij,ij->i", z, np.array(without)[fold])
            place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            tally += np.stack([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([tally.tobytes()], pa.binary())], names=["sums"])

    tally = np.zeros((2, BINS))
    for row in rows.select("stats", "label", "fold").mapInArrow(binned, "sums binary").collect():
        tally += np.frombuffer(row["sums"]).reshape(2, BINS)
    curve = pool(tally[0], tally[1], (np.arange(BINS) + 0.5) / BINS * 2 - 0.5)
    return QualityModel(features, _solve(gram.sum(axis=0), right.sum(axis=0)), curve)


def scored(stats: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of (doc_id, stats)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    kind = dict(stats.dtypes)["doc_id"]
    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, training: Column, **options) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; learns from labelled rows chosen by ``training``."""
    stats = written(with_statistics(docs), "statistics")
    return scored(stats, fit(stats, labels, training, **options))
