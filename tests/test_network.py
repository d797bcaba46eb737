"""Networks: gradients by finite differences, folds trained together as alone."""

import numpy as np
import pytest

from titleq.models import network
from titleq.models.network import Network, Settings
from titleq.session import written


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    rows = [(i, i % 4, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return written(spark.createDataFrame(rows, "index long, fold int, label double, x array<double>").repartition(3), "rows")


@pytest.mark.parametrize("linear", [True, False])
def test_gradients_equal_differences(data, linear):
    x, y = data[0][:20], data[1][:20]
    net = Network(5, Settings(hidden=3, linear=linear, seed=5))
    w = net.start + 0.1
    loss, gradient = net.gradient(w, x, y)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.gradient(w + step, x, y)[0] - net.gradient(w - step, x, y)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-5)
    assert loss > 0


def test_folds_trained_together_equal_a_loop(rows, data):
    x, y = data
    settings = Settings(steps=8, hidden=4)
    fitted = network.fit(rows, 5, settings)
    fold = np.arange(240) % 4
    for f in range(4):
        net, w = Network(5, settings), Network(5, settings).start.copy()
        m = v = np.zeros(net.size)
        for t in range(1, 9):
            loss, g = net.gradient(w, x[fold != f], y[fold != f])
            g = g / 180
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            assert fitted.losses[f][t - 1] == pytest.approx(loss / 180)
        assert fitted.weights[f] == pytest.approx(w, abs=1e-9)


def test_a_rule_of_two_features_is_learnt(rows):
    fitted = network.fit(rows, 5, Settings(steps=80, rate=0.05, hidden=8))
    assert all(x[-1] < 0.5 * x[0] for x in fitted.losses.values())
    got = network.held_out(rows, fitted, "index").collect()
    assert len({r["index"] for r in got}) == 240
    assert sum(r.label == r.prediction for r in got) / 240 > 0.8
    assert all((r.p1 > 0.5) == (r.prediction == 1) for r in got)


def test_one_class_and_no_rows(spark, rows):
    lone = spark.createDataFrame([(1, 0, 1.0, [0.0]), (2, 1, 1.0, [1.0]), (3, 1, 0.0, [2.0])], "index long, fold int, label double, x array<double>")
    fitted = network.fit(lone, 1, Settings(steps=2))
    assert fitted.only == {1: 1.0}
    got = {r["index"]: r.p1 for r in network.held_out(lone, fitted, "index").collect()}
    assert got[2] == got[3] == 1.0 and 0 < got[1] < 1
    none = network.fit(rows.limit(0), 5)
    assert network.held_out(rows.limit(0), none, "index").count() == 0
