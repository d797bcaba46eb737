"""Logistic regressions of many groups, grid points and folds, fitted together.

Every Newton step of all models is one scan: tasks sum gradients and curvatures for each (group, grid
point, left-out fold), Spark sums them over tasks, and the driver solves systems of the features' size.
So the number of scans depends on the steps alone, not on groups, folds or the grid. What the driver gets is groups x
grid x folds x features squared numbers.

The loss is that of Spark's estimator: mean logistic loss plus half the penalty times the squared
coefficients of the standardised features; the intercept is free. Features that don't vary within a model's
rows get the coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate

#: Newton steps at most, and the size of a step that ends the fit.
STEPS, CLOSE = 50, 1e-10
#: Fold number of the model that leaves out no rows.
WHOLE = -1


@dataclass(frozen=True)
class Point:
    """A grid point."""

    penalty: float
    intercept: bool


@dataclass
class Fit:
    """One model: coefficients, the intercept last; ``classes`` are the smallest and largest label of its rows."""

    coefficients: np.ndarray
    classes: tuple[float, float] | None

    def probability(self, x: np.ndarray) -> np.ndarray:
        low, high = self.classes
        if low == high:
            return np.full(len(x), low)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -500, 500)))


Key = tuple[object, int, int]  # group, grid point, left-out fold


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _parts(batch: pa.RecordBatch):
    """(group, its rows) of a batch."""
    groups = batch.column("group").dictionary_encode()
    place = groups.indices.to_numpy()
    for i, group in enumerate(groups.dictionary.to_pylist()):
        yield group, np.flatnonzero(place == i)


def _moments(rows: DataFrame, width: int) -> dict[object, dict[int, tuple]]:
    """{group: {fold: (rows, sums, square sums, least label, largest label)}}: one row per group and fold."""
    cells = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
    cells += [F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(width)]
    found = rows.groupBy("group", "fold").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), *cells)
    out: dict[object, dict[int, tuple]] = {}
    for r in found.collect():
        sums, squares = (np.array([r[f"{c}{i}"] for i in range(width)], float) for c in "sq")
        out.setdefault(r.group, {})[r.fold] = (r.n, sums, squares, r.low, r.high)
    return out


def _sums(rows: DataFrame, models: dict[Key, np.ndarray], width: int) -> dict[Key, tuple[float, np.ndarray, np.ndarray]]:
    """{model: (loss, gradient, curvature)} summed over the rows that each model does not leave out; one scan."""
    keys = list(models)
    by_group: dict[object, list[int]] = {}
    for i, key in enumerate(keys):
        by_group.setdefault(key[0], []).append(i)
    d = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(keys), 1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_matrix(batch), np.ones(batch.num_rows)])
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for group, mine in _parts(batch):
                for i in by_group.get(group, ()):
                    use = mine[fold[mine] != keys[i][2]]
                    a, b = x[use], y[use]
                    margin = a @ models[keys[i]]
                    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                    total[i, 0] += (np.logaddexp(0, margin) - b * margin).sum()
                    total[i, 1 : 1 + d] += a.T @ (p - b)
                    total[i, 1 + d :] += (a.T @ (a * (p * (1 - p))[:, None])).ravel()
        used = np.flatnonzero(total.any(axis=1))
        model = np.repeat(used, total.shape[1])
        cell = np.tile(np.arange(total.shape[1]), len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(model.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[used].ravel())], names=["model", "cell", "value"]
        )

    summed = rows.mapInArrow(run, "model int, cell int, value double").groupBy("model", "cell").agg(F.sum("value").alias("value"))
    table = summed.toArrow()
    values = np.zeros((len(keys), 1 + d + d * d))
    values[table["model"].to_numpy(), table["cell"].to_numpy()] = table["value"].to_numpy()
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in zip(keys, values)}


class _Model:
    """State of one fit: scales, the penalty's matrix, and Newton steps that are halved until the loss falls."""

    def __init__(self, point: Point, n: int, scale: np.ndarray):
        d = len(scale) + 1
        self.n, self.beta, self.done = n, np.zeros(d), False
        self.free = np.append(scale > 0, point.intercept)
        self.penalty = np.append(point.penalty * scale**2, 0.0)
        self.loss, self.base, self.step = np.inf, np.zeros(d), np.zeros(d)

    def move(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        loss = loss / self.n + 0.5 * (self.penalty * self.beta**2).sum()
        if loss > self.loss + 1e-12 * abs(self.loss):  # too far: half the last step
            self.step = self.step / 2
            self.beta = self.base + self.step
            self.done = np.abs(self.step).max() < CLOSE
            return
        g = gradient / self.n + self.penalty * self.beta
        h = curvature / self.n + np.diag(self.penalty)
        free = self.free
        step = np.zeros(len(self.beta))
        if free.any():
            step[free] = -np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=None)[0]
        self.loss, self.base, self.step = loss, self.beta, step
        self.beta = self.beta + step
        self.done = bool(np.abs(step).max() <= CLOSE * max(1.0, np.abs(self.beta).max()))


def fit(rows: DataFrame, grid: Sequence[Point], width: int, steps: int = STEPS) -> dict[Key, Fit]:
    """{(group, grid point, left-out fold): Fit} over stored rows (group, fold, label, x array<double> of ``width``).

    Every group has a model per grid point for each of its folds and for WHOLE. A model whose rows have one
    class only predicts that class; one without rows has no classes.
    """
    moments = _moments(rows, width)
    out: dict[Key, Fit] = {}
    open_models: dict[Key, _Model] = {}
    classes: dict[Key, tuple[float, float]] = {}
    for group, folds in moments.items():
        for left_out in [WHOLE, *folds]:
            used = [m for f, m in folds.items() if f != left_out]
            for i, point in enumerate(grid):
                key = group, i, left_out
                if not used:
                    out[key] = Fit(np.zeros(width + 1), None)
                    continue
                n = sum(m[0] for m in used)
                ends = min(m[3] for m in used), max(m[4] for m in used)
                if ends[0] == ends[1]:
                    out[key] = Fit(np.zeros(width + 1), ends)
                    continue
                mean = sum(m[1] for m in used) / n
                spread = np.maximum(sum(m[2] for m in used) / n - mean**2, 0) * n / max(n - 1, 1)
                scale = np.where(spread > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(spread), 0.0)
                open_models[key], classes[key] = _Model(point, n, scale), ends
    todo = dict(open_models)
    for _ in range(steps):
        if not todo:
            break
        for key, sums in _sums(rows, {k: m.beta for k, m in todo.items()}, width).items():
            todo[key].move(*sums)
        todo = {k: m for k, m in todo.items() if not m.done}
    return out | {k: Fit(m.beta, classes[k]) for k, m in open_models.items()}


def _applied(rows: DataFrame, models: dict[Key, Fit], points: int, held_out: bool, *keep: str) -> DataFrame:
    """(``keep`` ..., group, point, label, p1): probabilities of each row under its group's models.

    With ``held_out`` under those that leave out the row's fold, else under the WHOLE ones. A row whose group has no model
    gets null.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = _matrix(batch), batch.column("fold").to_numpy()
            found = np.full((batch.num_rows, points), np.nan)
            for group, mine in _parts(batch):
                for left_out in np.unique(fold[mine]).tolist() if held_out else [WHOLE]:
                    use = mine[fold[mine] == left_out] if held_out else mine
                    for i in range(points):
                        model = models.get((group, i, left_out))
                        if model is not None and model.classes is not None:
                            found[use, i] = model.probability(x[use])
            row = pa.array(np.repeat(np.arange(batch.num_rows), points))
            p1 = found.ravel()
            arrays = [*(batch.column(c).take(row) for c in (*keep, "group", "label")), pa.array(np.tile(np.arange(points, dtype=np.int32), batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p1, mask=np.isnan(p1))], names=[*keep, "group", "label", "point", "p1"])

    names = [f"{c} {kinds[c]}" for c in (*keep, "group", "label")]
    return rows.select(*dict.fromkeys([*keep, "group", "label", "fold", "x"])).mapInArrow(run, ", ".join([*names, "point int, p1 double"]))


def chosen_points(rows: DataFrame, models: dict[Key, Fit], points: int) -> dict[object, int]:
    """{group: grid point of largest mean area under the ROC curve over the folds}; ties to the earlier point.

    Folds without both classes don't count. Only groups x points x folds rows reach the driver.
    """
    scored = _applied(rows, models, points, True, "fold").where("p1 IS NOT NULL")
    areas = evaluate.auc(scored, score="p1", by=("group", "point", "fold")).where("auc IS NOT NULL")
    means = areas.groupBy("group", "point").agg(F.avg("auc").alias("auc")).collect()
    best: dict[object, tuple] = {}
    for r in means:
        best[r.group] = max(best.get(r.group, (-1.0, 0)), (round(r.auc, 12), -r.point))
    return {g: -p for g, (_, p) in best.items()}


def tuned(train: DataFrame, test: DataFrame, grid: Sequence[Point], width: int, *keep: str) -> DataFrame:
    """(``keep`` ..., group, label, prediction, p1, model): test rows under their group's tuned model.

    Both frames are stored and have (group, fold, label, x). ``model`` says whether it was fitted, knows a single
    class, or has no training rows; those get null predictions.
    """
    models = fit(train, grid, width)
    best = chosen_points(train, models, len(grid))
    final = {(g, 0, WHOLE): m for (g, i, f), m in models.items() if f == WHOLE and i == best.get(g, 0)}
    kinds = {g: "single class" if m.classes[0] == m.classes[1] else "fitted" for (g, _, _), m in final.items() if m.classes}
    scored = _applied(test, final, 1, False, *keep).drop("point")
    named = F.lit("no training rows")
    for group, kind in kinds.items():  # one entry per model
        named = F.when(F.col("group") == F.lit(group), kind).otherwise(named)
    return scored.withColumns({"prediction": (F.col("p1") > 0.5).cast("double"), "model": named})
