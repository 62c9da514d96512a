"""Networks: gradients against differences, shapes, and what they learn."""

import numpy as np
import pytest

from loamgrid.operators import networks as N

SMALL = {
    "cnn3d": {"channels": (2, 3), "kernels": ((3, 3, 3), (3, 3, 3)), "rate": 0.0, "widths": (6,)},
    "hybrid": {"channels": (2, 3), "kernels": ((3, 3, 3), (3, 3, 3)), "flat": (4, 5), "rate": 0.0, "widths": (6,)},
    "transformer": {"width": 8, "heads": 2, "layers": 2, "inner": 12, "rate": 0.0, "widths": (6,)},
    "resnet": {"stem": 4, "stages": (4, 6), "blocks": (1, 2), "rate": 0.0},
}


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_gradients_are_the_differences(kind):
    rng = np.random.default_rng(1)
    net = N.network(kind, 3, **SMALL[kind])
    net.train_rng = rng
    x, y = rng.normal(size=(4, 9, 7, 7)), np.array([0, 2, 1, 1])
    net.forward(N.Var(x))
    for w in net.weights.values():
        w.value = w.value.astype(np.float64)
    loss = lambda: N.cross_entropy(net.forward(N.Var(x)), y)
    loss().backward()
    checked = 0
    for name, w in net.weights.items():
        grad = np.zeros_like(w.value) if w.grad is None else w.grad
        for at in [np.unravel_index(i, w.value.shape) for i in rng.choice(w.value.size, min(4, w.value.size), replace=False)]:
            keep, h = w.value[at], 1e-6
            w.value[at] = keep + h
            up = float(loss().value)
            w.value[at] = keep - h
            down = float(loss().value)
            w.value[at] = keep
            assert grad[at] == pytest.approx((up - down) / (2 * h), abs=2e-5), name
            checked += 1
    assert checked > 20


def test_shapes_and_features():
    net = N.network("cnn3d", 4, **SMALL["cnn3d"])
    assert net.feature_size(16, 8) == net.weights["head0.w"].value.shape[0] == 3 * 4 * 2 * 2
    x = N.Var(np.zeros((2, 9, 7, 7), np.float32))
    assert all(N.network(k, 5, **s).forward(x).value.shape == (2, 5) for k, s in SMALL.items())
    with pytest.raises(ValueError, match="unknown network"):
        N.network("none", 2)


def test_pooling_and_convolution_against_loops():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(2, 3, 6, 5)), rng.normal(size=(4, 3, 3, 3))
    got = N.conv(N.Var(x), N.Var(w), 2, (1, 1)).value
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    for n, o, i, j in np.ndindex(*got.shape):
        assert got[n, o, i, j] == pytest.approx((p[n, :, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3] * w[o]).sum())
    pooled = N.max_pool(N.Var(x), 2).value
    assert pooled.shape == (2, 3, 3, 2) and pooled[1, 2, 2, 1] == x[1, 2, 4:6, 2:4].max()


def test_schedules_and_batches():
    assert [round(N.scheduled("step", 1.0, e, 9, 0), 6) for e in (0, 3, 8)] == [1.0, 0.1, 0.01]
    assert N.scheduled("cosine", 1.0, 5, 10, 0) == pytest.approx(0.5) and N.scheduled("plateau", 1.0, 9, 10, 10) == 0.25
    parts = list(N.batches(33, 8, np.random.default_rng(0)))
    assert sorted(np.concatenate(parts).tolist()) == list(range(33)) and min(map(len, parts)) == 8


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_a_scene_is_learnt(spark, kind):
    rng = np.random.default_rng(3)
    cls = (np.add.outer(np.arange(14), np.arange(12)) // 6) % 2
    spec = rng.normal(size=(14, 12, 9)) * 0.05 + np.where(cls[:, :, None] == 1, np.linspace(0, 1, 9), np.linspace(1, 0, 9))
    cube = spark.createDataFrame([(r * 12 + c, r, c, int(cls[r, c]), spec[r, c].tolist()) for r in range(14) for c in range(12)], "id long, row long, col long, label long, spec array<double>")
    rows = N.pixel_patches(cube, 5)
    one = rows.where("id = 0").first()["patch"]
    padded = np.pad(spec, ((2, 2), (2, 2), (0, 0)), mode="symmetric")
    assert np.allclose(one, padded[:5, :5].ravel())
    fitted = N.fit(rows, kind, 5, 2, N.Training(epochs=12, batch=16, rate=0.01), **SMALL[kind])
    got = N.predict(fitted, rows).collect()
    hits = np.mean([r["prediction"] == cls[divmod(r["id"], 12)] for r in got])
    assert len(got) == 168 and hits > 0.9 and all(abs(sum(r["p"]) - 1) < 1e-4 for r in got)
    assert {"epoch", "loss", "held_out_accuracy"} <= set(fitted.history[0])
    assert N.predict(fitted, rows.limit(0)).count() == 0
