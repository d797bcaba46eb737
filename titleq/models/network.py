"""Small neural networks with one hidden layer, one per fold, trained together by Adam.

A step is one scan: tasks sum the gradients of all folds' networks, Spark sums them over the tasks, and
the driver, which keeps the weights and the moments of Adam, moves the weights. What the driver and the tasks hold is bounded by
folds x layers; rows are never collected. The loss is the mean cross entropy of two classes.

The hidden layer may be linear. First weights depend on the seed alone, so results do not depend on the
partitions, up to rounding. A fold whose training rows have one class only predicts it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    steps: int = 60
    rate: float = 0.01
    hidden: int | None = None  # by default half of inputs and outputs together
    linear: bool = False
    decay: tuple[float, float] = (0.9, 0.999)
    seed: int = 42


class Network:
    """Weights in one flat vector: inputs x hidden, hidden, hidden x 2, 2."""

    def __init__(self, width: int, settings: Settings):
        self.width, self.linear = width, settings.linear
        self.hidden = settings.hidden or (width + 2) // 2
        self.cuts = np.cumsum([width * self.hidden, self.hidden, self.hidden * 2])
        self.size = int(self.cuts[-1]) + 2
        rng = np.random.default_rng(settings.seed)
        scale = np.repeat([width**-0.5, 0.0, self.hidden**-0.5, 0.0], [width * self.hidden, self.hidden, self.hidden * 2, 2])
        self.start = rng.normal(size=self.size) * scale

    def parts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, c, d = np.split(weights, self.cuts)
        return a.reshape(self.width, self.hidden), b, c.reshape(self.hidden, 2), d

    def forward(self, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, probabilities of both classes)."""
        a, b, c, d = self.parts(weights)
        h = x @ a + b
        h = h if self.linear else np.tanh(h)
        z = h @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return h, z / z.sum(axis=1, keepdims=True)

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, gradient) summed over rows."""
        h, p = self.forward(weights, x)
        row = np.arange(len(x))
        label = y.astype(int)
        loss = -np.log(np.maximum(p[row, label], 1e-300)).sum()
        out = p.copy()
        out[row, label] -= 1
        back = out @ self.parts(weights)[2].T
        back = back if self.linear else back * (1 - h * h)
        return float(loss), np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (h.T @ out).ravel(), out.sum(axis=0)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, network: Network, weights: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """{fold: (loss, gradient)} over the rows of all other folds; one scan."""
    folds = sorted(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), network.size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _matrix(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for i, f in enumerate(folds):
                use = fold != f
                if use.any():
                    loss, gradient = network.gradient(weights[f], x[use], y[use])
                    total[i] += np.append(gradient, loss)
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "value"])

    table = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(len(folds) * (network.size + 1))
    total[table["place"].to_numpy()] = table["value"].to_numpy()
    return {f: (float(t[-1]), t[:-1]) for f, t in zip(folds, total.reshape(len(folds), -1))}


@dataclass
class Fitted:
    """Networks by left-out fold, or the one class of its training rows, and the mean loss of each step."""

    network: Network
    weights: dict[int, np.ndarray]
    only: dict[int, float]
    losses: dict[int, list[float]]


def fit(rows: DataFrame, width: int, settings: Settings = Settings()) -> Fitted:
    """A network for each fold of the stored rows (fold, label 0 or 1, x array<double>), trained on the other folds."""
    network = Network(width, settings)
    counts = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    only, size = {}, {}
    for f in counts:
        others = [r for g, r in counts.items() if g != f]
        ends = {r.low for r in others} | {r.high for r in others}
        if len(ends) < 2:
            only[f] = ends.pop() if ends else 0.0
        else:
            size[f] = sum(r.n for r in others)
    out = Fitted(network, {f: network.start.copy() for f in size}, only, {f: [] for f in size})
    first, second = ({f: np.zeros(network.size) for f in size} for _ in range(2))
    a, b = settings.decay
    for step in range(1, settings.steps + 1 if size else 0):
        for f, (loss, gradient) in _sums(rows, network, out.weights).items():
            g = gradient / size[f]
            first[f] = a * first[f] + (1 - a) * g
            second[f] = b * second[f] + (1 - b) * g * g
            move = first[f] / (1 - a**step) / (np.sqrt(second[f] / (1 - b**step)) + 1e-8)
            out.weights[f] = out.weights[f] - settings.rate * move
            out.losses[f].append(loss / size[f])
    return out


def held_out(rows: DataFrame, fitted: Fitted, *keep: str) -> DataFrame:
    """(``keep`` ..., fold, label, prediction, p1): every row under the network that left out its fold."""
    kinds = dict(rows.dtypes)
    names = list(dict.fromkeys([*keep, "fold", "label"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1 = np.zeros(batch.num_rows)
            x = _matrix(batch) if batch.num_rows else None
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                use = fold == f
                p1[use] = fitted.only[f] if f in fitted.only else fitted.network.forward(fitted.weights[f], x[use])[1][:, 1]
            arrays = [*(batch.column(c) for c in names), pa.array((p1 > 0.5).astype(float)), pa.array(p1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "prediction", "p1"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "prediction double, p1 double"])
    return rows.select(*names, "x").mapInArrow(run, schema)
