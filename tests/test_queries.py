"""Every registered query with SQL gives the rows of its SQL; the others keep their invariants."""

import pytest

import __spark_entry__ as entry

from .conftest import SMALL
from .oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, con, name):
    agrees, remark = compare(spark, con, name, SMALL)
    assert agrees, remark


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", ["snk_model", "ml_tvs", "ml_random_forest", "ml_mlp"])
def test_probabilities(spark, name):
    rows = run(spark, name)
    assert rows and all(0 <= r.p1 <= 1 and r.prediction in (0.0, 1.0) for r in rows)
    assert len({r["index"] for r in rows}) == len(rows)


def test_same_seed_same_forest(spark):
    key = lambda r: r["index"]
    assert sorted(run(spark, "ml_random_forest"), key=key) == sorted(
        run(spark, "ml_random_forest"), key=key
    )


def test_topics(spark):
    rows = run(spark, "ml_lda_topics")
    per = {}
    for r in rows:
        per.setdefault((r.seg_a, r.topic), []).append(r)
    assert len(per) == 10
    for terms in per.values():
        assert len(terms) == 30 and sorted(t["rank"] for t in terms) == list(range(1, 31))
        weights = [t.weight for t in sorted(terms, key=lambda t: t["rank"])]
        assert weights == sorted(weights, reverse=True)


def test_word2vec_covers_the_vocabulary(spark):
    rows = run(spark, "ml_word2vec")
    words = run(spark, "txt_stem_dictionary")
    assert {r.dim for r in rows} == {200}
    assert {r.token for r in rows} <= {w.token for w in words}


def test_principal_components_come_in_order(spark):
    import numpy as np

    rows = run(spark, "ml_pca")
    values = np.array([[r[f"pc{i}"] for i in range(1, 11)] for r in rows])
    spread = values.var(axis=0)
    assert len(rows) == 200 and all(a >= b - 1e-9 for a, b in zip(spread, spread[1:]))


def test_fold_metrics_add_up(spark):
    rows = run(spark, "ml_svc_kfold")
    assert len(rows) == 5
    for r in rows:
        assert r.n == r.tn + r.fp + r.fn + r.tp
        assert r.accuracy == pytest.approx((r.tn + r.tp) / r.n, abs=1e-6)
        assert r.rmse == pytest.approx((1 - r.accuracy) ** 0.5, abs=1e-6)


@pytest.mark.parametrize("name", ["ml_random_forest", "ml_mlp"])
def test_ten_folds_test_every_row(spark, name):
    rows = run(spark, name)
    titles = QUERIES["ml_one_hot"](spark, SMALL).select("index").collect()
    assert sorted(r["index"] for r in rows) == sorted(r["index"] for r in titles)
    assert {r.fold for r in rows} == set(range(10))
    metrics = run(spark, f"{name}_kfold")
    right = {f: [r.label == r.prediction for r in rows if r.fold == f] for f in range(10)}
    assert {r.fold: r.n for r in metrics} == {f: len(x) for f, x in right.items()}
    assert all(r.accuracy == pytest.approx(sum(right[r.fold]) / r.n, abs=1e-6) for r in metrics)


def test_larger_grid_is_the_given_one(spark, monkeypatch):
    from titleq.models import training

    class Stop(Exception):
        pass

    def tuned(estimator, grid, evaluator=None, **_):
        points = [{p.name: v for p, v in point.items()} for point in grid]
        assert len(points) == 27 and evaluator is None
        for name, values in (("maxBins", {16, 32, 64}), ("maxDepth", {3, 5, 7}), ("minInfoGain", {0.0, 2.0, 5.0})):
            assert {p[name] for p in points} == values
        raise Stop

    monkeypatch.setattr(training, "cross_validated", tuned)
    with pytest.raises(Stop):
        run(spark, "ml_gbt_grid")


def test_models_per_category_report_single_classes(spark):
    from titleq.models import training

    rows = spark.createDataFrame(
        [(i, "one" if i % 2 else "two", [float(i % 7)], float(i % 4 == 1)) for i in range(200)],
        "index long, category_1 string, x array<double>, label double",
    )
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rows = rows.withColumn("features", array_to_vector("x")).withColumn(
        "label", F.when(F.col("category_1") == "two", 1.0).otherwise(F.col("label"))
    )
    out = training.per_category(rows, ["one", "two", "absent"]).collect()
    kinds = {(r.category_1, r.model) for r in out}
    assert kinds == {("one", "gbt"), ("two", "single class")}
    assert all(r.prediction == 1.0 for r in out if r.category_1 == "two")


def test_categories_without_training_rows_keep_their_test_rows(spark):
    from pyspark.sql import functions as F

    from titleq.models import training
    from titleq.operators import evaluate

    rows = spark.range(100).select(F.col("id").alias("index"), F.lit(1.0).alias("label"), F.array(F.lit(1.0)).alias("features"))
    train, test = evaluate.split(rows)
    rare = test.limit(2).withColumn("category_1", F.lit("rare"))
    out = training.per_category(train.withColumn("category_1", F.lit("one")).unionByName(rare), ["one", "rare"]).collect()
    assert [(r.category_1, r.label, r.prediction, r.p1, r.model) for r in out] == [("rare", 1.0, None, None, "no training rows")] * 2
