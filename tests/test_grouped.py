"""Regressions fitted together against Spark's own single fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from titleq.models import grouped
from titleq.operators import evaluate
from titleq.session import written

from .conftest import SMALL

GRID = [grouped.Point(0.1, False), grouped.Point(0.1, True), grouped.Point(0.01, True)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        group = "abc"[i % 3]
        x = rng.normal(size=4) * [1, 20, 0.1, 0] + [0, 50, 1, 7]
        odds = {"a": x[0] * 2 - 1, "b": (x[1] - 50) / 10, "c": 10 * (x[2] - 1) + x[0]}[group]
        out.append((i, group, int(rng.integers(3)), float(rng.random() < 1 / (1 + np.exp(-odds))), x.tolist()))
    out += [(1000 + i, "one", i % 3, 1.0, [float(i), 0.0, 1.0, 2.0]) for i in range(9)]
    out += [(2000, "lone", 2, 0.0, [0.0, 0.0, 0.0, 0.0])]
    return written(spark.createDataFrame(out, "index long, group string, fold int, label double, x array<double>"), "rows")


@pytest.fixture(scope="module")
def models(rows):
    return grouped.fit(rows, GRID, 4)


def test_coefficients_equal_single_fits(rows, models):
    for group, left_out, i in [("a", -1, 0), ("a", 1, 1), ("b", -1, 2), ("b", 0, 1), ("c", 2, 0), ("c", -1, 1)]:
        part = rows.where((F.col("group") == group) & (F.col("fold") != left_out)).select(array_to_vector("x").alias("features"), "label")
        point = GRID[i]
        one = LogisticRegression(regParam=point.penalty, fitIntercept=point.intercept, maxIter=500, tol=1e-12).fit(part)
        want = [*one.coefficients.toArray(), one.intercept]
        assert models[group, i, left_out].coefficients == pytest.approx(want, abs=1e-6)


def test_all_models_are_there(models):
    assert {k for k in models if k[0] in "abc"} == {(g, i, f) for g in "abc" for i in range(3) for f in (-1, 0, 1, 2)}
    assert models["one", 0, -1].classes == (1.0, 1.0)
    assert models["lone", 0, 2].classes is None and models["lone", 0, -1].classes == (0.0, 0.0)


def test_scans_do_not_grow_with_groups(spark, rows, monkeypatch):
    scans = []
    sums = grouped._sums
    monkeypatch.setattr(grouped, "_sums", lambda *a: scans.append(1) or sums(*a))
    grouped.fit(rows.where("group = 'a'"), GRID[1:2], 4)
    few = len(scans)
    grouped.fit(rows, GRID, 4)
    assert len(scans) - few <= few + 4 and few < 15


def test_best_point_by_mean_area(rows, models):
    got = grouped.chosen_points(rows, models, len(GRID))
    data = {}
    for r in rows.collect():
        data.setdefault((r.group, r.fold), []).append((r.label, np.array(r.x)))
    for group in "abc":
        means = []
        for i in range(len(GRID)):
            areas = []
            for fold in range(3):
                y = np.array([label for label, _ in data[group, fold]])
                p = models[group, i, fold].probability(np.array([x for _, x in data[group, fold]]))
                one, zero = p[y == 1], p[y == 0]
                areas.append(np.mean((one[:, None] > zero) + 0.5 * (one[:, None] == zero)))
            means.append(round(float(np.mean(areas)), 12))
        assert got[group] == means.index(max(means))
    assert "one" not in got


def test_test_rows_are_all_kept(spark, rows):
    train = written(rows.where("index < 700 OR group = 'one'"), "train")
    test = written(rows.where("index >= 700"), "test")
    out = {r["index"]: r for r in grouped.tuned(train, test, GRID, 4, "index").collect()}
    assert len(out) == test.count()
    assert out[1001].model == "single class" and out[1001].p1 == 1.0 and out[1001].prediction == 1.0
    assert out[2000].model == "no training rows" and out[2000].p1 is None and out[2000].prediction is None
    assert all(0 < r.p1 < 1 and r.model == "fitted" for i, r in out.items() if i < 900)
    assert grouped.tuned(train.limit(0), test.limit(0), GRID, 4, "index").count() == 0


def test_area_by_group_equals_area_of_the_group(rows):
    scored = rows.select("group", "label", F.round(F.col("x")[0], 1).alias("score"))
    by = {r.group: r.auc for r in evaluate.auc(scored, by=("group",)).collect()}
    for group in "abc":
        assert by[group] == pytest.approx(evaluate.auc(scored.where(F.col("group") == group)).first().auc)
    assert by["one"] is None


def test_metrics_follow_from_the_predictions(spark):
    queries = entry.queries()
    rows = [r for r in queries["ml_logreg_per_category"](spark, SMALL).collect() if r.prediction is not None]
    got = {r.category_1: r for r in queries["ml_logreg_per_category_metrics"](spark, SMALL).collect()}
    assert set(got) == {r.category_1 for r in rows}
    for name, m in got.items():
        part = [r for r in rows if r.category_1 == name]
        assert m.n == len(part) == m.tn + m.fp + m.fn + m.tp
        assert m.tp == sum(r.label == 1 and r.prediction == 1 for r in part)
        pairs = [(a.p1 > b.p1) + 0.5 * (a.p1 == b.p1) for a in part if a.label == 1 for b in part if b.label == 0]
        assert m.auc == (pytest.approx(np.mean(pairs), abs=1e-9) if pairs else None)
