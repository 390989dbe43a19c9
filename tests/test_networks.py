"""The trained networks: gradients against finite differences, stopping, and losses against the linear detectors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import networks, windows
from tests.helpers import START


def window_rows(spark, series, length, cut=0.8):
    """Sliding windows of plain series, with the first part of each as train."""
    rows = []
    for name, x in series.items():
        n = int(len(x) * cut)
        for i, v in enumerate(x):
            split, pos = ("train", i) if i < n else ("test", i - n)
            rows.append((name, split, START + dt.timedelta(minutes=i), float(v), pos, pos // 512))
    df = spark.createDataFrame(rows, "slice_id string, split string, ts timestamp_ntz, value double, pos bigint, chunk bigint")
    return windows.sliding_windows(df, length, 512)


def check_gradient(network, fixed, x, y):
    draw = np.random.default_rng(1)
    at = draw.normal(0, 0.5, network.size)
    loss, gradient = network.loss_and_gradient(at, fixed, x, y)
    assert loss == pytest.approx(network.loss(at, fixed, x, y))
    for i in draw.choice(network.size, min(60, network.size), replace=False):
        step = np.zeros(network.size)
        step[i] = 1e-5
        slope = (network.loss(at + step, fixed, x, y) - network.loss(at - step, fixed, x, y)) / 2e-5
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_gradients():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(7, 6)), draw.normal(size=7)
    check_gradient(networks.GatedForecaster(6, hidden=3), draw.normal(size=7), x, y)
    check_gradient(networks.StackedEncoder(6, (5, 3, 2), (2, 3, 5)), draw.normal(size=18), x, y)


def test_networks_start_from_the_linear_answer():
    draw = np.random.default_rng(2)
    x, coef = draw.normal(size=(5, 8)), draw.normal(size=9)
    net = networks.GatedForecaster(8)
    np.testing.assert_allclose(net.output(net.start(), coef, x), coef[0] + x @ coef[1:])
    axes = np.linalg.qr(draw.normal(size=(8, 4)))[0].T
    mean = draw.normal(size=8)
    encoder = networks.StackedEncoder(8)
    want = mean + (x - mean) @ axes.T @ axes
    np.testing.assert_allclose(encoder.output(encoder.start(), np.concatenate([mean, axes.ravel()]), x), want)


def test_stops_on_a_plateau_and_keeps_the_best():
    net = networks.GatedForecaster(2, 1)
    state = dict(step=0, waited=0, done=False, train_loss=np.inf, held_loss=np.inf, best_loss=np.inf,
                 weights=np.zeros(net.size), sizes=np.full(net.size, 0.1), gradient=np.zeros(net.size), best=np.zeros(net.size), fixed=np.zeros(3))
    held, seen = [1.0, 0.5, 0.5, 0.6, 0.5], []
    for loss in held:
        seen.append(state["weights"])
        state = networks.next_state(state, 10, 10 * loss, 5, 5 * loss, np.ones(net.size), 100, 3, 1e-3)
    assert state["done"] and state["step"] == 5 and state["best_loss"] == 0.5
    np.testing.assert_array_equal(state["best"], seen[1])
    np.testing.assert_allclose(state["sizes"], 0.1 * 1.2**3)  # the gradient kept its sign
    turned = networks.next_state(dict(state, done=False, gradient=np.ones(net.size)), 10, 5, 5, 2, -np.ones(net.size), 100, 9, 1e-3)
    np.testing.assert_allclose(turned["sizes"], 0.05 * 1.2**3)
    np.testing.assert_array_equal(turned["weights"], state["weights"])


def curved(n, seed):
    """A logistic map: the next value is a parabola of the last one, which no straight line follows."""
    x = np.empty(n)
    x[0] = 0.3 + 0.01 * seed
    for i in range(1, n):
        x[i] = 3.8 * x[i - 1] * (1 - x[i - 1])
    return x


def mean_loss(df, split):
    return {r["slice_id"]: r["l"] for r in df.filter(F.col("split") == split).groupBy("slice_id").agg(F.avg("loss").alias("l")).collect()}


def test_gated_forecast_is_better_than_a_line(spark):
    found = window_rows(spark, {"a": curved(900, 1), "b": curved(700, 2)}, 4).cache()
    model = networks.fit_gated_forecast(found, steps=60)
    gated = mean_loss(networks.gated_forecast_loss(found, model, against="target"), "test")
    line = mean_loss(windows.forecast_loss(found, windows.fit_forecast(found), "target"), "test")
    assert set(gated) == set(line) == {"a", "b"} and all(gated[k] < 0.5 * line[k] for k in gated)
    window = networks.gated_forecast_loss(found, model).orderBy("slice_id", "split", "pos").first()
    first = found.orderBy("slice_id", "split", "pos").first()
    assert window["loss"] == pytest.approx(np.mean((np.array(first["x"]) - window["predicted"]) ** 2))


def test_stacked_encoder_is_better_than_components(spark):
    found = window_rows(spark, {"a": curved(900, 3), "b": np.sin(np.arange(600) / 5)}, 6).cache()
    model = networks.fit_stacked_encoder(found, narrow=(16, 8, 2), widen=(2, 8, 16), steps=60)
    stacked = mean_loss(networks.stacked_encoder_loss(found, model, (16, 8, 2), (2, 8, 16)), "test")
    linear = mean_loss(windows.window_reconstruction_loss(found, windows.fit_window_autoencoder(found, k=2)), "test")
    assert stacked["a"] < 0.9 * linear["a"] and stacked["b"] <= linear["b"] + 1e-6


def test_one_training_is_the_same_in_rounds_and_with_many_partial_sums(spark, monkeypatch):
    found = window_rows(spark, {name: curved(200 + 10 * i, i) for i, name in enumerate("abcd")}, 3).repartition(5).cache()
    plain = networks.fit_gated_forecast(found, hidden=2, steps=4).select("slice_id", "best", "best_loss", "step").orderBy("slice_id").collect()
    monkeypatch.setattr(networks, "FAN", 2)
    apart = networks.fit_gated_forecast(found, hidden=2, steps=4, broadcast_bytes=2000).select("slice_id", "best", "best_loss", "step").orderBy("slice_id").collect()
    assert [r["slice_id"] for r in plain] == [r["slice_id"] for r in apart] == list("abcd")
    for a, b in zip(plain, apart):
        np.testing.assert_allclose(a["best"], b["best"], rtol=1e-6, atol=1e-9)


def test_networks_of_nothing(spark):
    empty = window_rows(spark, {"a": curved(50, 1)}, 3).filter("false")
    assert networks.fit_gated_forecast(empty).count() == 0
    test_only = window_rows(spark, {"a": curved(50, 1)}, 3).filter("split = 'test'")
    assert networks.fit_stacked_encoder(test_only).count() == 0
