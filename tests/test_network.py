"""The graph network: gradients against differences, causality, the loss by hand, training and scores over Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidebook.operators import network as N
from tidebook.operators.graph import ATTRIBUTES


def _inputs(rng, nodes=4, time=5, channels=3):
    x = rng.normal(size=(nodes, time, channels))
    src, dst = np.array([0, 1, 2, 3, 1, 0]), np.array([0, 1, 2, 2, 2, 1])
    edge = np.hstack([rng.normal(size=(6, len(ATTRIBUTES))), np.eye(N.RELATIONS)[[0, 0, 0, 2, 3, 4]]])
    return x, src, dst, edge


def test_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    shape = N.Shape(3, hidden=4, horizons=2, heads=2)
    inputs, y, ok, group = _inputs(rng), rng.normal(size=(4, 2)), np.array([1, 1, 1, 1], bool), np.zeros(4, int)
    flat = shape.first(1) + 0.05 * rng.normal(size=len(shape.first(1)))
    loss = lambda w: N.loss_slope(N.forward(shape, shape.split(w), *inputs).data, y, ok, group)[0]
    named = shape.split(flat)
    out = N.forward(shape, named, *inputs)
    slope = N.loss_slope(out.data, y, ok, group)[1]
    N.Value((out.data * slope).sum(), [(out, lambda g: g * slope)]).backward()
    got = np.concatenate([(np.zeros(p.data.shape) if p.grad is None else p.grad).ravel() for p in named.values()])
    for i in rng.choice(len(flat), 120, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=2e-6), i


def test_loss_by_hand():
    y = np.array([[1.0], [2.0], [3.0], [9.0]])
    ok, group = np.array([1, 1, 1, 0], bool), np.zeros(4, int)
    assert N.loss_slope(y + 5.0, y, ok, group)[0] == pytest.approx(-0.5)
    assert N.loss_slope(-y, y, ok, group)[0] == pytest.approx((1.5 + 0.0 + 1.5) / 3 + 0.5)
    value, slope = N.loss_slope(y, y, np.array([1, 1, 0, 0], bool), group)
    assert value == 0.0 and not slope.any()


def test_delays_see_no_later_time():
    x = np.arange(6.0).reshape(1, 6, 1)
    assert N.delayed(N.Value(x), 2).data.ravel().tolist() == [0, 0, 0, 1, 2, 3]
    assert not N.delayed(N.Value(x), 8).data.any()


def test_training_finds_a_planted_signal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for ti in range(200):
        v = rng.normal(size=5)
        rows += [(ti, f"n{i}", float(v[i]), None if i == 4 and ti == 7 else 1.0, float(v[i]), True) for i in range(5)]
    panel = spark.createDataFrame(rows, "ti long, node string, a double, b double, y double, target_valid boolean")
    ends = panel.where("ti >= 2").select(F.col("ti").alias("te"), F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("rel"), *[F.lit(0.0).alias(c) for c in ATTRIBUTES])
    windows = N.windows(panel, ends, ["a", "b"], ["y"], 3)
    first = windows.orderBy("te").first()
    assert first.te == 2 and first.nodes == [f"n{i}" for i in range(5)] and len(first.x) == 3 * 5 * 2 and first.x[-10::2] == first.y
    assert windows.count() == 198
    shape = N.Shape(2, hidden=8, horizons=1, heads=2)
    assert N.train(windows.limit(10), shape) is None
    weights = N.train(windows, shape, epochs=6, rate=1e-2)
    got = N.predict(windows, shape, weights).join(panel.withColumnRenamed("ti", "te"), ["te", "node"])
    assert got.count() == 198 * 5 and got.agg(F.corr("score", "y")).first()[0] > 0.8
