"""Encoder and decoder of windows."""

import numpy as np
import pytest

from tidemark import registry
from tidemark.operators import autoencoder, network, windows
from tidemark.operators.autoencoder import AutoencoderParams


def waves(spark, n=200, size=6):
    series = spark.createDataFrame([(i, float(np.sin(i / 3) * 0.6 + 0.2)) for i in range(n)], "pos long, v double")
    return series, windows.sliding_window(series, size, "v")


def test_gradients_match_differences(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(rng.normal(0, 1, 5).tolist(),) for _ in range(9)], "w array<double>").repartition(3)
    nets = autoencoder.fresh(5, AutoencoderParams(interface=2, hidden=(4, 3)))
    layers = [*nets.encoder, *nets.decoder]
    assert [layer.weights.shape for layer in layers] == [(4, 5), (3, 4), (2, 3), (3, 2), (4, 3), (5, 4)]
    found = autoencoder.gradients(rows, layers)
    at = network.flat([layers])
    assert found[1] == 45 and len(found) == 2 + len(at)
    for i in (0, 7, 21, 40, len(at) - 1):
        step = np.zeros(len(at))
        step[i] = 1e-6
        up, down = (autoencoder.gradients(rows, network.shaped(at + s, [layers])[0])[0] for s in (step, -step))
        assert found[2 + i] == pytest.approx((up - down) / 4e-6, rel=1e-3, abs=1e-6)
    assert len(autoencoder.gradients(rows.limit(0), layers)) == 0


def test_training_lowers_the_error(spark, tmp_path):
    series, held = waves(spark)
    params = AutoencoderParams(interface=2, hidden=(8,), epochs=12, batches=2, lr=0.02, seed=1)
    nets, losses = autoencoder.fit(held, params)
    assert len(losses) == 12 and losses[-1] < 0.3 * losses[0]
    assert autoencoder.fit(held, params)[1] == pytest.approx(losses)
    mse = autoencoder.calculate_mse(held, nets)
    plain = [(np.array(r.w), network.evaluate(network.evaluate(np.array([r.w]), nets.encoder), nets.decoder)[0]) for r in held.collect()]
    assert mse == pytest.approx(np.mean([np.mean((a - b) ** 2) for a, b in plain])) and mse < losses[0]
    codes = autoencoder.encode(held, nets)
    assert all(len(r.code) == 2 and max(map(abs, r.code)) <= 1 for r in codes.collect())
    nets.save(spark, str(tmp_path / "ae"))
    back = autoencoder.Autoencoder.load(spark, str(tmp_path / "ae"))
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip([*nets.encoder, *nets.decoder], [*back.encoder, *back.decoder], strict=True)) and back.size == 6
    whole = autoencoder.reconstruct(series, nets, "v").orderBy("pos").collect()
    assert [r.pos for r in whole] == list(range(200))
    truth = [r.v for r in series.orderBy("pos").collect()]
    assert np.mean([(r.output - t) ** 2 for r, t in zip(whole, truth, strict=True)]) <= mse * 1.5


def test_odd_windows(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,), ([None, 1.0],), ([float("nan"), 1.0],), ([0.5, 0.5],)], "w array<double>")
    nets, losses = autoencoder.fit(rows, AutoencoderParams(interface=1, hidden=(), epochs=2, batches=3))
    assert len(losses) == 2 and autoencoder.calculate_mse(rows, nets) == pytest.approx(np.mean([np.mean((np.array(w) - network.evaluate(network.evaluate(np.array([w]), nets.encoder), nets.decoder)[0]) ** 2) for w in ([1.0, 2.0], [0.5, 0.5])]))
    assert [r.code is None for r in autoencoder.encode(rows.limit(2), nets).collect()] == [False, True]
    assert autoencoder.calculate_mse(rows.limit(0), nets) is None
    for odd in (rows.limit(0), rows.filter("w IS NULL"), spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "w array<double>")):
        with pytest.raises(ValueError):
            autoencoder.fit(odd, AutoencoderParams(epochs=1))


def test_plugins(spark):
    _, held = waves(spark, 30)
    fit_encoder, params = registry.load_plugin("encoders", "ann")
    fit_decoder, _ = registry.load_plugin("decoders", "ann")
    assert "interface" in params
    own = {"interface": 2, "hidden": (), "epochs": 1, "batches": 1}
    assert fit_encoder(held, **own)[-1].weights.shape == (2, 6) and fit_decoder(held, **own)[-1].weights.shape == (6, 2)
