"""Small neural networks over pixel patches in numpy: 3-D and hybrid convolutions, spectral attention,
residual blocks.

A reverse-mode tape (:class:`Var`) carries the gradients.  Training takes a bounded sample of labelled
patches, ``Training.max_rows`` of them by a hash of the id (a documented parameter), to the driver;
the fitted weights, a few megabytes, are broadcast, and every row is predicted in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.stencil import box, grid_size, spread


class Var:
    """A value on the tape: its gradient, what it was made of, and how a gradient flows back."""

    def __init__(self, value: np.ndarray, parents: tuple[Var, ...] = (), back: Callable | None = None) -> None:
        self.value, self.parents, self.back = value, parents, back
        self.grad: np.ndarray | None = None

    def backward(self) -> None:
        order, seen = [], set()

        def visit(v: Var) -> None:
            if id(v) not in seen:
                seen.add(id(v))
                for p in v.parents:
                    visit(p)
                order.append(v)

        visit(self)
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                for p, g in zip(v.parents, v.back(v.grad), strict=True):
                    if g is not None:
                        p.grad = g if p.grad is None else p.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which a value of ``shape`` was repeated."""
    g = g.sum(tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] > 1)
    return g.sum(wide, keepdims=True) if wide else g


def add(a: Var, b: Var) -> Var:
    return Var(a.value + b.value, (a, b), lambda g: (_fit(g, a.value.shape), _fit(g, b.value.shape)))


def matmul(a: Var, b: Var) -> Var:
    turned = lambda x: np.swapaxes(x, -1, -2)
    return Var(a.value @ b.value, (a, b), lambda g: (_fit(g @ turned(b.value), a.value.shape), _fit(turned(a.value) @ g, b.value.shape)))


def scale(a: Var, k: float) -> Var:
    return Var(a.value * k, (a,), lambda g: (g * k,))


def relu(a: Var) -> Var:
    on = a.value > 0
    return Var(a.value * on, (a,), lambda g: (g * on,))


def reshape(a: Var, *shape: int) -> Var:
    return Var(a.value.reshape(shape), (a,), lambda g: (g.reshape(a.value.shape),))


def transpose(a: Var, *axes: int) -> Var:
    return Var(a.value.transpose(axes), (a,), lambda g: (g.transpose(np.argsort(axes)),))


def mean(a: Var, axes: tuple[int, ...]) -> Var:
    n = math.prod(a.value.shape[i] for i in axes)
    return Var(a.value.mean(axes), (a,), lambda g: (np.broadcast_to(np.expand_dims(g, axes) / n, a.value.shape),))


def softmax(a: Var) -> Var:
    e = np.exp(a.value - a.value.max(-1, keepdims=True))
    y = e / e.sum(-1, keepdims=True)
    return Var(y, (a,), lambda g: (y * (g - (g * y).sum(-1, keepdims=True)),))


def dropout(a: Var, rate: float, rng: np.random.Generator | None) -> Var:
    if rng is None or rate <= 0:
        return a
    keep = (rng.random(a.value.shape) >= rate) / (1 - rate)
    return Var(a.value * keep, (a,), lambda g: (g * keep,))


def conv(x: Var, w: Var, stride: int = 1, pad: tuple[int, ...] = ()) -> Var:
    """(n, in, *space) by (out, in, *kernel); ``pad`` by axis of space."""
    kernel = w.value.shape[2:]
    d = len(kernel)
    pad = pad or (0,) * d
    p = np.pad(x.value, ((0, 0), (0, 0), *((k, k) for k in pad)))
    space = tuple(range(2, 2 + d))
    view = np.lib.stride_tricks.sliding_window_view(p, kernel, space)[(slice(None), slice(None), *(slice(None, None, stride),) * d)]
    inner = (1, *range(2 + d, 2 + 2 * d))
    out = np.moveaxis(np.tensordot(view, w.value, (inner, (1, *space))), -1, 1)

    def back(g: np.ndarray) -> tuple:
        dw = np.tensordot(g, view, ((0, *space), (0, *space)))
        dp = np.zeros_like(p)
        for at in np.ndindex(*kernel):
            here = (slice(None), slice(None), *(slice(i, i + stride * n, stride) for i, n in zip(at, g.shape[2:], strict=True)))
            dp[here] += np.moveaxis(np.tensordot(g, w.value[(slice(None), slice(None), *at)], (1, 0)), -1, 1)
        return dp[(slice(None), slice(None), *(slice(k, k + n) for k, n in zip(pad, x.value.shape[2:], strict=True)))], dw

    return Var(out, (x, w), back)


def max_pool(x: Var, size: int, stride: int | None = None, pad: int = 0) -> Var:
    """Maxima over cubes of space; axes shorter than ``size`` are taken whole."""
    d, stride = x.value.ndim - 2, stride or size
    kernel = tuple(min(size, n + 2 * pad) for n in x.value.shape[2:])
    p = np.pad(x.value, ((0, 0), (0, 0), *((pad, pad),) * d), constant_values=-np.inf)
    view = np.lib.stride_tricks.sliding_window_view(p, kernel, tuple(range(2, 2 + d)))[(slice(None), slice(None), *(slice(None, None, stride),) * d)]
    flat = view.reshape(*view.shape[: 2 + d], -1)
    top = flat.argmax(-1)

    def back(g: np.ndarray) -> tuple:
        dp = np.zeros_like(p)
        at = np.indices(top.shape)
        inside = np.unravel_index(top, kernel)
        np.add.at(dp, (at[0], at[1], *(at[2 + i] * stride + inside[i] for i in range(d))), g)
        return (dp[(slice(None), slice(None), *(slice(pad, pad + n) for n in x.value.shape[2:]))],)

    return Var(np.take_along_axis(flat, top[..., None], -1)[..., 0], (x,), back)


def normalise(x: Var, gamma: Var, beta: Var, axes: tuple[int, ...], known: tuple[np.ndarray, np.ndarray] | None = None) -> Var:
    """(x - mean) / deviation over axes, or with known moments, times gamma plus beta."""
    m, v = known or (x.value.mean(axes, keepdims=True), x.value.var(axes, keepdims=True))
    r = 1 / np.sqrt(v + 1e-5)
    z = (x.value - m) * r

    def back(g: np.ndarray) -> tuple:
        dz = g * gamma.value
        dx = dz * r if known else r * (dz - dz.mean(axes, keepdims=True) - z * (dz * z).mean(axes, keepdims=True))
        return dx, _fit(g * z, gamma.value.shape), _fit(g, beta.value.shape)

    return Var(z * gamma.value + beta.value, (x, gamma, beta), back)


def cross_entropy(scores: Var, labels: np.ndarray) -> Var:
    p = softmax(Var(scores.value)).value
    n = len(labels)

    def back(g: np.ndarray) -> tuple:
        d = p.copy()
        d[np.arange(n), labels] -= 1
        return (g * d / n,)

    return Var(np.array(-np.log(p[np.arange(n), labels] + 1e-12).mean()), (scores,), back)


class Network:
    """Named weights and running moments, made when a layer first meets its input."""

    def __init__(self, classes: int, seed: int = 42, **settings) -> None:
        self.classes, self.settings = classes, {**self.defaults, **settings}
        self.weights: dict[str, Var] = {}
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.make = np.random.default_rng(seed)
        self.train_rng: np.random.Generator | None = None

    defaults: dict = {}

    def weight(self, name: str, shape: tuple[int, ...], fan: int = 0, fill: float = 0.0) -> Var:
        if name not in self.weights:
            value = self.make.normal(scale=math.sqrt(2 / fan), size=shape) if fan else np.full(shape, fill)
            self.weights[name] = Var(value.astype(np.float32))
        return self.weights[name]

    def dense(self, x: Var, name: str, out: int) -> Var:
        n = x.value.shape[-1]
        return add(matmul(x, self.weight(f"{name}.w", (n, out), n)), self.weight(f"{name}.b", (out,)))

    def conv(self, x: Var, name: str, out: int, kernel: tuple[int, ...], stride: int = 1, pad: tuple[int, ...] = ()) -> Var:
        n = x.value.shape[1]
        return conv(x, self.weight(f"{name}.w", (out, n, *kernel), n * math.prod(kernel)), stride, pad)

    def batch_norm(self, x: Var, name: str) -> Var:
        shape = (1, x.value.shape[1]) + (1,) * (x.value.ndim - 2)
        axes = (0, *range(2, x.value.ndim))
        gamma, beta = self.weight(f"{name}.g", shape, fill=1.0), self.weight(f"{name}.o", shape)
        if self.train_rng is None and name in self.moments:
            return normalise(x, gamma, beta, axes, self.moments[name])
        now = x.value.mean(axes, keepdims=True), x.value.var(axes, keepdims=True)
        old = self.moments.get(name, now)
        self.moments[name] = tuple(0.9 * a + 0.1 * b for a, b in zip(old, now, strict=True))
        return normalise(x, gamma, beta, axes)

    def layer_norm(self, x: Var, name: str) -> Var:
        n = x.value.shape[-1]
        return normalise(x, self.weight(f"{name}.g", (n,), fill=1.0), self.weight(f"{name}.o", (n,)), (-1,))

    def drop(self, x: Var, rate: float) -> Var:
        return dropout(x, rate, self.train_rng)

    def head(self, x: Var, widths: tuple[int, ...], rate: float) -> Var:
        for i, n in enumerate(widths):
            x = self.drop(relu(self.dense(x, f"head{i}", n)), rate)
        return self.dense(x, "scores", self.classes)

    def forward(self, x: Var) -> Var:
        """Class scores of (n, bands, rows, columns)."""
        raise NotImplementedError

    def feature_size(self, bands: int, patch: int) -> int:
        """Features that reach the head for patches of a shape."""
        self.forward(Var(np.zeros((1, bands, patch, patch), np.float32)))
        return self.weights["head0.w" if "head0.w" in self.weights else "scores.w"].value.shape[0]

    def state(self) -> dict:
        return {"kind": type(self).__name__, "classes": self.classes, "settings": self.settings, "weights": {k: v.value for k, v in self.weights.items()}, "moments": dict(self.moments)}


class Cnn3d(Network):
    """Blocks of 3-D convolution, normalisation, pooling and dropout, then dense layers."""

    defaults = {"channels": (32, 64, 128), "kernels": ((7, 3, 3), (5, 3, 3), (3, 3, 3)), "rate": 0.5, "widths": (512, 256)}

    def forward(self, x: Var) -> Var:
        s = self.settings
        x = reshape(x, x.value.shape[0], 1, *x.value.shape[1:])
        for i, (out, kernel) in enumerate(zip(s["channels"], s["kernels"], strict=True)):
            x = relu(self.batch_norm(self.conv(x, f"conv{i}", out, kernel, 1, (1, 1, 1)), f"norm{i}"))
            x = self.drop(max_pool(x, 2), s["rate"] / 2)
        return self.head(reshape(x, x.value.shape[0], -1), s["widths"], s["rate"])


class Hybrid(Network):
    """3-D convolutions over the spectrum, then 2-D ones over all that they found."""

    defaults = {"channels": (8, 16, 32), "kernels": ((7, 3, 3), (5, 3, 3), (3, 3, 3)), "flat": (64, 128, 256), "rate": 0.4, "widths": (512, 256)}

    def forward(self, x: Var) -> Var:
        s = self.settings
        x = reshape(x, x.value.shape[0], 1, *x.value.shape[1:])
        for i, (out, kernel) in enumerate(zip(s["channels"], s["kernels"], strict=True)):
            x = relu(self.batch_norm(self.conv(x, f"deep{i}", out, kernel, 1, (0, 1, 1)), f"deepnorm{i}"))
        n, c, d, h, w = x.value.shape
        x = reshape(x, n, c * d, h, w)
        for i, out in enumerate(s["flat"]):
            x = relu(self.batch_norm(self.conv(x, f"flat{i}", out, (3, 3), 1, (1, 1)), f"flatnorm{i}"))
            x = max_pool(x, 2) if i == len(s["flat"]) - 1 else self.drop(x, s["rate"] / 2)
        return self.head(mean(x, (2, 3)), s["widths"], s["rate"])


class Transformer(Network):
    """The centre pixel's bands as a sequence: embedding, attention layers, mean over bands."""

    defaults = {"width": 512, "heads": 8, "layers": 6, "inner": 2048, "rate": 0.1, "widths": (512,)}

    def attention(self, x: Var, name: str) -> Var:
        n, t, width = x.value.shape
        heads = self.settings["heads"]
        split = lambda part: transpose(reshape(self.dense(x, f"{name}.{part}", width), n, t, heads, width // heads), 0, 2, 1, 3)
        q, k, v = split("q"), split("k"), split("v")
        seen = matmul(self.drop(softmax(scale(matmul(q, transpose(k, 0, 1, 3, 2)), (width // heads) ** -0.5)), self.settings["rate"]), v)
        return self.dense(reshape(transpose(seen, 0, 2, 1, 3), n, t, width), f"{name}.out", width)

    def forward(self, x: Var) -> Var:
        s = self.settings
        at = x.value.shape[-1] // 2
        centre = Var(x.value[:, :, at, at][:, :, None])
        x = add(self.dense(centre, "embed", s["width"]), self.weight("place", (1, centre.value.shape[1], s["width"]), 2))
        for i in range(s["layers"]):
            x = self.layer_norm(add(x, self.drop(self.attention(x, f"seen{i}"), s["rate"])), f"seennorm{i}")
            inner = self.dense(self.drop(relu(self.dense(x, f"in{i}", s["inner"])), s["rate"]), f"out{i}", s["width"])
            x = self.layer_norm(add(x, self.drop(inner, s["rate"])), f"outnorm{i}")
        return self.head(self.layer_norm(mean(x, (1,)), "last"), s["widths"], s["rate"])


class Residual(Network):
    """A stem, then stages of residual blocks, each but the first at half the size of the last."""

    defaults = {"stem": 64, "stages": (64, 128, 256, 512), "blocks": (2, 2, 2, 2), "rate": 0.5}

    def block(self, x: Var, name: str, out: int, stride: int) -> Var:
        y = relu(self.batch_norm(self.conv(x, f"{name}.a", out, (3, 3), stride, (1, 1)), f"{name}.an"))
        y = self.batch_norm(self.conv(y, f"{name}.b", out, (3, 3), 1, (1, 1)), f"{name}.bn")
        if stride != 1 or x.value.shape[1] != out:
            x = self.batch_norm(self.conv(x, f"{name}.c", out, (1, 1), stride), f"{name}.cn")
        return relu(add(y, x))

    def forward(self, x: Var) -> Var:
        s = self.settings
        x = max_pool(relu(self.batch_norm(self.conv(x, "stem", s["stem"], (7, 7), 2, (3, 3)), "stemnorm")), 3, 2, 1)
        for i, (out, blocks) in enumerate(zip(s["stages"], s["blocks"], strict=True)):
            for b in range(blocks):
                x = self.block(x, f"stage{i}.{b}", out, 2 if i and not b else 1)
        return self.head(mean(x, (2, 3)), (), s["rate"])


NETWORKS: dict[str, type[Network]] = {"cnn3d": Cnn3d, "hybrid": Hybrid, "transformer": Transformer, "resnet": Residual}


def network(kind: str, classes: int, seed: int = 42, **settings) -> Network:
    if kind not in NETWORKS:
        raise ValueError(f"unknown network {kind}; known: {', '.join(NETWORKS)}")
    return NETWORKS[kind](classes, seed, **settings)


def restored(state: dict) -> Network:
    kinds = {c.__name__: c for c in NETWORKS.values()}
    net = kinds[state["kind"]](state["classes"], **state["settings"])
    net.weights = {k: Var(v) for k, v in state["weights"].items()}
    net.moments = state["moments"]
    return net


def pixel_patches(cube: DataFrame, size: int = 11) -> DataFrame:
    """Rows of a cube (row, col, spec and others) with ``patch``: the spectra of the window around the
    pixel, edges mirrored, row by row in one array."""
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    sent = spread(cube.select("row", "col", "spec"), box(size), True, grid_size(cube))
    # A window has size * size pixels.
    window = sent.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("dr", "dc", "spec"))).alias("w"))
    return cube.join(window.select("row", "col", F.flatten(F.transform("w", lambda x: x["spec"])).alias("patch")), ["row", "col"])


@dataclass(frozen=True)
class Training:
    epochs: int = 50
    batch: int = 32
    rate: float = 0.001
    optimiser: str = "adam"
    schedule: str = "plateau"
    patience: int = 10
    holdout: float = 0.2
    decay: float = 0.0
    max_rows: int = 20_000
    seed: int = 42


class Optimiser:
    """Adam, or gradient steps with momentum, over named weights."""

    def __init__(self, kind: str, rate: float, decay: float = 0.0) -> None:
        if kind not in ("adam", "sgd"):
            raise ValueError(f"unknown optimiser {kind}; known: adam, sgd")
        self.kind, self.rate, self.decay, self.step = kind, rate, decay, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def update(self, weights: dict[str, Var]) -> None:
        self.step += 1
        for name, w in weights.items():
            if w.grad is None:
                continue
            g = w.grad + self.decay * w.value
            m = self.first.get(name, np.zeros_like(g))
            if self.kind == "sgd":
                m = 0.9 * m + g
                move = m
            else:
                v = 0.999 * self.second.get(name, np.zeros_like(g)) + 0.001 * g * g
                m = 0.9 * m + 0.1 * g
                self.second[name] = v
                move = m / (1 - 0.9**self.step) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            self.first[name] = m
            w.value = (w.value - self.rate * move).astype(np.float32)
            w.grad = None


def scheduled(kind: str, rate: float, epoch: int, epochs: int, stale: int) -> float:
    """The rate of an epoch: constant, tenths by thirds (step), cosine, or halves when stale (plateau)."""
    known = {"none": 1.0, "step": 0.1 ** (epoch * 3 // max(1, epochs)), "cosine": (1 + math.cos(math.pi * epoch / max(1, epochs))) / 2, "plateau": 0.5 ** (stale // 5)}
    if kind not in known:
        raise ValueError(f"unknown schedule {kind}; known: {', '.join(known)}")
    return rate * known[kind]


@dataclass
class Fitted:
    """A trained network, the scaling of its bands, its patch size and its history by epoch."""

    state: dict
    low: np.ndarray
    high: np.ndarray
    size: int
    history: list[dict[str, float]] = field(default_factory=list)

    def arrays(self, flat: np.ndarray) -> np.ndarray:
        """(n, size * size * bands) to scaled (n, bands, size, size)."""
        x = flat.reshape(len(flat), self.size, self.size, -1)
        x = (x - self.low) / np.where(self.high > self.low, self.high - self.low, 1.0)
        return np.ascontiguousarray(x.transpose(0, 3, 1, 2), np.float32)

    def scores(self, flat: np.ndarray, net: Network | None = None, batch: int = 256) -> np.ndarray:
        net = net or restored(self.state)
        out = [softmax(net.forward(Var(self.arrays(flat[i : i + batch])))).value for i in range(0, len(flat), batch)]
        return np.concatenate(out) if out else np.zeros((0, net.classes))


def batches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Places of all rows in a drawn order, a batch at a time; a batch of one joins the one before."""
    order = rng.permutation(n)
    cuts = list(range(0, n, size))
    if len(cuts) > 1 and n - cuts[-1] == 1:
        cuts.pop()
    return (order[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True))


def _rows(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    col = table.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float32).reshape(len(col), -1)


def fit(rows: DataFrame, kind: str, size: int, classes: int, training: Training | None = None, **settings) -> Fitted:
    """Trains on (id, label, patch); the epoch with the best held-out accuracy stays."""
    t = training or Training()
    known = rows.where("label is not null").select("id", F.col("label").cast("long").alias("label"), "patch")
    table = known.orderBy(F.xxhash64("id", F.lit(t.seed)), "id").limit(t.max_rows).toArrow()
    flat, labels = _rows(table, "patch"), np.asarray(table["label"])
    if not len(flat):
        raise ValueError("no labelled rows")
    pixels = flat.reshape(len(flat) * size * size, -1)
    out = Fitted({}, pixels.min(0), pixels.max(0), size)
    rng = np.random.default_rng(t.seed)
    order = rng.permutation(len(flat))
    n_test = int(len(flat) * t.holdout)
    test, train = order[:n_test], order[n_test:]
    x = out.arrays(flat)
    net, opt = network(kind, classes, t.seed, **settings), Optimiser(t.optimiser, t.rate, t.decay)
    best, stale = -1.0, 0
    for epoch in range(t.epochs):
        opt.rate = scheduled(t.schedule, t.rate, epoch, t.epochs, stale)
        net.train_rng, loss, hits = rng, 0.0, 0
        for at in batches(len(train), t.batch, rng):
            at = train[at]
            scores = net.forward(Var(x[at]))
            e = cross_entropy(scores, labels[at])
            e.backward()
            opt.update(net.weights)
            loss, hits = loss + float(e.value) * len(at), hits + int((scores.value.argmax(1) == labels[at]).sum())
        net.train_rng = None
        checked = test if len(test) else train
        p = np.concatenate([net.forward(Var(x[checked[i : i + 256]])).value for i in range(0, len(checked), 256)])
        held = float((p.argmax(1) == labels[checked]).mean())
        out.history.append({"epoch": epoch, "rate": opt.rate, "loss": loss / len(train), "accuracy": hits / len(train), "held_out_loss": float(cross_entropy(Var(p), labels[checked]).value), "held_out_accuracy": held})
        stale = 0 if held > best else stale + 1
        if held > best:
            best, out.state = held, net.state()
        if stale > t.patience:
            break
    return out


def predict(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """id, prediction and p (array) of every row (id, patch)."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        net = restored(f.state)
        for part in parts:
            p = f.scores(_rows(part, "patch"), net) if part.num_rows else np.zeros((0, net.classes))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p.argmax(1), pa.int64()), pa.array(list(p.astype(np.float64)), pa.list_(pa.float64()))], names=["id", "prediction", "p"])

    return rows.select(F.col("id").cast("long").alias("id"), "patch").mapInArrow(run, "id long, prediction long, p array<double>")
