"""Steps of optimisers by value, gradients by differences, layers, modes and parameters."""

import math

import numpy as np
import pytest

from tessera import errors
from tessera.plans import Adam, Dense, Dropout, RmsProp, Sequential, Sgd, flattened


def steps(optimiser, n):
    p, out = np.array([1.0]), []
    for _ in range(n):
        p = optimiser.step("p", p, np.array([0.1]))
        out.append(float(p[0]))
    return out


def test_steps():
    assert np.allclose(steps(Sgd(0.1), 2), [0.99, 0.98])
    assert np.allclose(steps(Sgd(0.1, 0.9), 2), [0.99, 0.971])
    assert np.allclose(steps(Adam(0.1), 1), [0.9], atol=1e-6)
    assert np.allclose(steps(RmsProp(0.1), 1), [1 - 0.01 / math.sqrt(0.001)], atol=1e-6)


@pytest.mark.parametrize(("activations", "loss"), [(["relu", "sigmoid"], "mse"), (["tanh", "softmax"], "cross_entropy"), (["sigmoid", "linear"], "mse")])
def test_gradients(activations, loss):
    rng = np.random.default_rng(1)
    model = Sequential([3, 4, 2], activations, seed=2, loss=loss)
    model.layers.insert(1, Dropout(0.5, 3))
    x, y = rng.standard_normal((5, 3)), np.eye(2)[rng.integers(0, 2, 5)]
    (total, count), *grads = model._gradients(x, y)
    for p, g in zip(model.parameters().values(), grads, strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = model._gradients(x, y)[0][0]
            p[i] -= 2e-6
            down = model._gradients(x, y)[0][0]
            p[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-4
    assert count in (len(x), y.size) and np.isfinite(total)


def test_modes_and_parameters(spark, tmp_path):
    model = Sequential().add(Dense(2, 6, "tanh")).add(Dropout(0.5, 7)).add(Dense(6, 1, "sigmoid", 1))
    assert list(model.parameters()) == ["w0", "b0", "w1", "b1"] and model.parameters()["w0"].shape == (2, 6)
    rows = spark.createDataFrame([(i, [float(i % 2), float(i // 2 % 2)], [float(i % 2 != i // 2 % 2)]) for i in range(8)], "row_id long, x array<double>, y array<double>")
    model.save(spark, str(tmp_path / "m"))
    again = Sequential.load(spark, str(tmp_path / "m"))
    kept = [[r.p for r in m.eval().forward(rows).orderBy("row_id").collect()] for m in (model, again, model)]
    assert kept[0] == kept[1] == kept[2]
    assert [r.p for r in model.train().forward(rows).orderBy("row_id").collect()] != kept[0]
    losses = model.fit(rows, Adam(0.1), 3)
    assert len(losses) == 3 and all(map(math.isfinite, losses))


def test_dropout_keeps_the_mean():
    x = np.ones((200, 50))
    for rate in (0.0, 0.3, 1.0):
        layer = Dropout(rate, 1)
        mask = layer.mask(x)
        mean = 1.0 if mask is None else mask.mean()
        assert abs(mean - (rate < 1)) < 0.05
    assert (Dropout(0.3, 1).mask(x) == Dropout(0.3, 1).mask(x)).all() and (Dropout(0.3, 1).mask(x) != Dropout(0.3, 2).mask(x)).any()
    with pytest.raises(ValueError, match="rate"):
        Dropout(1.5)


def test_flattened(spark):
    rows = spark.createDataFrame([([[[1.0], [2.0]], [[3.0], [4.0]]], [1.0])], "x array<array<array<double>>>, y array<double>")
    assert flattened(rows, "x").first().x == [1, 2, 3, 4]
    with pytest.raises(errors.RankMismatch):
        flattened(rows, "y")
