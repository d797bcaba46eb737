"""Isolation and local density against literal loops, and planted outliers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleq.models import outliers
from titleq.session import written


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 2, 0.5]
    x[:8] = [[9, 0, 0], [0, 19, 0], [0, 0, 6], [-9, 9, 3], [8, -15, 1], [7, 7, -4], [-8, 0, 4], [0, -20, 2]]
    x[20:24] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0])]
    return written(spark.createDataFrame(rows, "index long, x array<double>"), "cloud")


def good(cloud):
    rows = [r for r in cloud.collect() if r["index"] < 900]
    return {r["index"]: np.array(r.x) for r in rows}


def test_path_lengths_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 4))
    x[5] = x[6]
    tree = outliers.grow(x, np.random.default_rng(2))

    def walk(row, node=0, depth=0):
        if tree.feature[node] < 0:
            return depth, node
        low = row[tree.feature[node]] < tree.threshold[node]
        return walk(row, (tree.left if low else tree.right)[node], depth + 1)

    ends = [walk(row) for row in x]
    sizes = {n: sum(e[1] == n for e in ends) for n in {e[1] for e in ends}}
    want = [d + outliers.mean_path(sizes[n]) for d, n in ends]
    assert tree.lengths(x) == pytest.approx(want)
    assert max(d for d, _ in ends) <= 6 and min(sizes.values()) >= 1
    assert outliers.grow(np.ones((9, 2)), rng).lengths(np.zeros((1, 2))) == pytest.approx(outliers.mean_path(9))


def test_planted_rows_are_isolated(cloud):
    model = outliers.forest(cloud, "index", "x", trees=60, sample=128)
    assert len(model.trees) == 60 and model.sample == 128
    assert all(len(t.path) < 256 for t in model.trees)
    got = {r["index"]: r.score for r in outliers.isolation_scores(cloud, "x", model, "index").collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4
    want = model.scores(np.array(list(good(cloud).values())))
    assert [got[i] for i in good(cloud)] == pytest.approx(want.tolist())
    assert len({got[i] for i in range(20, 24)}) == 1


def test_planted_rows_are_among_the_flagged_share(cloud):
    """With the given parameters all planted rows lie in the 2 % of largest scores."""
    model = outliers.forest(cloud, "index", "x")
    got = {r["index"]: r.score for r in outliers.isolation_scores(cloud.where("index < 900"), "x", model, "index").collect()}
    assert set(range(8)) <= set(sorted(got, key=got.get)[-12:])


def test_a_tree_sees_the_rows_of_smallest_hash(cloud):
    """Partitions don't matter, and small tables are used whole."""
    a, b = (outliers.forest(cloud.repartition(p), "index", "x", trees=5, sample=32) for p in (1, 7))
    assert all((x.threshold == y.threshold).all() and (x.path == y.path).all() for x, y in zip(a.trees, b.trees))
    whole = outliers.forest(cloud, "index", "x", trees=3, sample=5000)
    assert whole.sample == 600


def literal_factors(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = []
    for i in range(n):
        near.append(sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k])
    reach = [d[i, near[i][-1]] for i in range(n)]
    density = [1 / (np.mean([max(d[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(n)]
    return [np.mean([density[j] for j in near[i]]) / density[i] for i in range(n)]


def test_factors_equal_loops(cloud):
    rows = cloud.where("index < 20 OR index > 23")  # without the equal rows, whose neighbours tie
    model = outliers.density(rows, "index", "x", k=7)
    got = {r["index"]: r.score for r in outliers.outlier_factors(rows, "x", model, "index").collect()}
    x = good(rows)
    assert [got[i] for i in x] == pytest.approx(literal_factors(np.array(list(x.values())), 7), rel=1e-6)
    assert got[900] is None
    assert set(range(8)) <= set(sorted(x, key=got.get)[-12:])


def test_a_bounded_reference_scores_all(cloud):
    model = outliers.density(cloud, "index", "x", k=5, most=100)
    assert len(model.reference) == 100
    rows = outliers.outlier_factors(cloud, "x", model, "index").collect()
    assert sum(r.score is not None for r in rows) == 600
    best = sorted((r for r in rows if r.score is not None), key=lambda r: r.score)[-12:]
    assert len({r["index"] for r in best} & set(range(8))) >= 6


def test_few_rows(spark, cloud):
    none = cloud.limit(0)
    model = outliers.forest(none, "index", "x", trees=2)
    assert outliers.isolation_scores(none, "x", model, "index").count() == 0
    assert outliers.outlier_factors(none, "x", outliers.density(none, "index", "x"), "index").count() == 0
    one = spark.createDataFrame([(1, [2.0])], "index long, x array<double>")
    assert math.isfinite(outliers.isolation_scores(one, "x", outliers.forest(one, "index", "x", trees=2), "index").first().score)
    assert outliers.outlier_factors(one, "x", outliers.density(one, "index", "x"), "index").first().score == 1.0
    two = one.union(one.select(F.lit(2).cast("long"), F.array(F.lit(3.0))))
    assert {r.score for r in outliers.outlier_factors(two, "x", outliers.density(two, "index", "x"), "index").collect()} == {1.0}


@pytest.mark.parametrize("name", ["ml_isolation_forest", "ml_local_outliers"])
def test_two_of_a_hundred_are_flagged(spark, name):
    import __spark_entry__ as entry

    from .conftest import SMALL

    rows = entry.queries()[name](spark, SMALL).collect()
    assert len({r["index"] for r in rows}) == len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for segment in (True, False):
        part = [r for r in rows if r.seg_a == segment]
        flagged = [r.score for r in part if r.outlier]
        assert 0 < len(flagged) <= 0.02 * len(part) + 1
        assert min(flagged) > max(r.score for r in part if not r.outlier)


def test_the_reference_is_the_whole_table(spark, monkeypatch):
    """Density counts all rows, over however many cells, and ties go by the hash of the key as in one loop over all rows."""
    monkeypatch.setattr(outliers, "CELL_ROWS", 300)
    monkeypatch.setattr(outliers, "QUERIES", 250)
    monkeypatch.setattr(outliers, "HELD_ROWS", 500)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 3)) ** 3
    x[:800] = rng.integers(0, 4, (800, 3))  # many equal rows and many ties
    x[800:1400] = x[800]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)]
    df = written(spark.createDataFrame(rows, "index long, x array<double>").repartition(5), "ties")
    model = outliers.density(df, "index", "x", k=6)
    assert len(model.reference) == 2500 and len(model.reference.numbers) > 10
    got = {r["index"]: r.score for r in outliers.outlier_factors(df, "x", model, "index").collect()}
    assert got.pop(9000) is None and len(got) == 2500

    place = F.xxhash64(F.col("index").cast("string"), F.lit(42)).bitwiseAND((1 << 52) - 1)
    order = [r["index"] for r in df.where("x IS NOT NULL").orderBy(place).collect()]
    ref = x[order]
    d = ((ref[:, None] - ref[None]) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1, kind="stable")  # ties to the earlier hash; the first of the equal rows is left out
    near = np.take_along_axis(near, (d.min(axis=1) == 0).astype(int)[:, None] + np.arange(6), axis=1)
    far = np.sqrt(np.take_along_axis(d, near, axis=1))
    reach = far[:, -1]
    thick = 1 / (np.maximum(far, reach[near]).mean(axis=1) + 1e-10)
    want = dict(zip(order, thick[near].mean(axis=1) / thick))
    assert [got[i] for i in range(2500)] == pytest.approx([want[i] for i in range(2500)], rel=1e-9)


def test_density_takes_no_fixed_number_of_rows():
    import inspect

    assert inspect.signature(outliers.density).parameters["most"].default is None
