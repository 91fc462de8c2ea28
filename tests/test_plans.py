"""Models: losses fall, and a saved model predicts the same."""

import pytest

from tessera.plans import Adam, RmsProp, Sequential, Sgd

XOR = [(0, [0.0, 0.0], [0.0]), (1, [0.0, 1.0], [1.0]), (2, [1.0, 0.0], [1.0]), (3, [1.0, 1.0], [0.0])]


@pytest.mark.parametrize(("optimiser", "start"), [(Sgd(0.1), "xavier"), (Sgd(0.05, 0.9), "uniform"), (Adam(0.05), "he"), (RmsProp(0.01), "xavier")])
def test_xor(spark, optimiser, start):
    rows = spark.createDataFrame(XOR, "row_id long, x array<double>, y array<double>").coalesce(1)
    losses = Sequential([2, 4, 1], ["tanh", "sigmoid"], start=start).fit(rows, optimiser, 5)
    assert losses[-1] < losses[0]


def test_classes_and_saving(spark, tmp_path):
    rows = spark.createDataFrame([(i, x, [1.0 - y[0], y[0]]) for i, x, y in XOR], "row_id long, x array<double>, y array<double>").coalesce(1)
    model = Sequential([2, 8, 2], ["tanh", "softmax"], loss="cross_entropy")
    losses = model.fit(rows, Adam(0.1), 12)
    assert losses[-1] < losses[0]
    model.save(spark, str(tmp_path / "model"))
    predicted = [[r.p for r in m.forward(rows).orderBy("row_id").collect()] for m in (model, Sequential.load(spark, str(tmp_path / "model")))]
    assert predicted[0] == predicted[1] and all(abs(sum(p) - 1) < 1e-9 for p in predicted[0])
