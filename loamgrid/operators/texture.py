"""Texture kernels over tiles with a halo: what windows of runs, circles and filters need whole arrays for.

A pixel goes to its own tile and to each tile whose halo holds it, so a tile is one bounded Arrow
group; results are kept for the tile's own pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.stencil import grid_size


def by_tile(grid: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int, tile: int = 128) -> DataFrame:
    """row, col, v: kernel of (row, col, v) on each tile, edges mirrored; kernel keeps the shape."""
    size = grid_size(grid)
    near = lambda x: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(x) + d) / tile)))
    sent = grid.join(F.broadcast(size)).withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    sent = sent.where(f"tr >= 0 and tc >= 0 and tr * {tile} < h and tc * {tile} < w")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, r0, c0 = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        r1, c1 = min(r0 + tile, h), min(c0 + tile, w)
        top, left, bottom, right = max(0, r0 - halo), max(0, c0 - halo), min(h, r1 + halo), min(w, c1 + halo)
        img = np.zeros((bottom - top, right - left))
        p = pdf[(pdf["row"] >= top) & (pdf["row"] < bottom) & (pdf["col"] >= left) & (pdf["col"] < right)]
        img[p["row"] - top, p["col"] - left] = p["v"]
        pad = ((halo - (r0 - top), halo - (bottom - r1)), (halo - (c0 - left), halo - (right - c1)))
        out = kernel(np.pad(img, pad, mode="symmetric"))[halo : halo + r1 - r0, halo : halo + c1 - c0]
        rr, cc = np.mgrid[r0:r1, c0:c1]
        return pd.DataFrame({"row": rr.ravel(), "col": cc.ravel(), "v": out.ravel().astype(float)})

    return sent.groupBy("tr", "tc").applyInPandas(run, "row long, col long, v double").join(grid.select("row", "col"), ["row", "col"], "left_semi")


def lbp_kernel(radius: int = 3, points: int = 24, uniform: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """Circular binary patterns by bilinear sampling; uniform codes count ones, others are points + 1."""

    def run(img: np.ndarray) -> np.ndarray:
        p = np.pad(img, radius + 1, mode="symmetric")
        h, w = img.shape
        bits = []
        for k in range(points):
            y, x = -radius * math.sin(2 * math.pi * k / points), radius * math.cos(2 * math.pi * k / points)
            fy, fx = math.floor(y), math.floor(x)
            ty, tx, b = y - fy, x - fx, radius + 1
            at = lambda dy, dx, fy=fy, fx=fx, b=b: p[b + fy + dy : b + fy + dy + h, b + fx + dx : b + fx + dx + w]
            bits.append((1 - ty) * (1 - tx) * at(0, 0) + (1 - ty) * tx * at(0, 1) + ty * (1 - tx) * at(1, 0) + ty * tx * at(1, 1) >= img - 1e-12)
        b = np.stack(bits)
        if not uniform:
            codes = [sum(np.roll(b, s, 0)[k].astype(np.int64) << k for k in range(points)) for s in range(points)]
            return np.min(np.stack(codes), 0).astype(float)
        turns = (b != np.roll(b, 1, 0)).sum(0)
        return np.where(turns <= 2, b.sum(0), points + 1).astype(float)

    return run


def gabor(frequency: float, theta: float, half: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts of a Gabor filter, deviation 1 / (2 pi frequency)."""
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    s = 1 / (2 * math.pi * frequency)
    g = np.exp(-(x * x + y * y) / (2 * s * s))
    phase = 2 * math.pi * frequency * (x * math.cos(theta) + y * math.sin(theta))
    return g * np.cos(phase), g * np.sin(phase)


def convolution(kernel: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def run(img: np.ndarray) -> np.ndarray:
        h, w = kernel.shape
        p = np.pad(img, ((h // 2, h // 2), (w // 2, w // 2)), mode="symmetric")
        view = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
        return np.einsum("ijkl,kl->ij", view, kernel[::-1, ::-1])

    return run


def run_lengths(a: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values of a sequence."""
    if not len(a):
        return np.zeros(0, int)
    cut = np.flatnonzero(np.diff(a)) + 1
    return np.diff(np.concatenate([[0], cut, [len(a)]]))


RUN_FEATURES = {
    "sre": lambda r: float((1.0 / r**2).mean()),
    "lre": lambda r: float((r.astype(float) ** 2).mean()),
    "gln": lambda r: float(r.var()),
    "rln": lambda r: float(len(np.unique(r))),
    "rp": lambda r: float(len(r) / r.sum()),
}


def run_kernel(feature: str, angle: int = 0, size: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """A run-length feature of each window along rows (0), columns (90) or diagonals (45, 135)."""
    f = RUN_FEATURES[feature]

    def lines(w: np.ndarray) -> list[np.ndarray]:
        if angle == 0:
            return list(w)
        if angle == 90:
            return list(w.T)
        m = w if angle == 135 else w[:, ::-1]
        return [np.diagonal(m, k) for k in range(-size + 1, size)]

    def run(img: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(np.pad(img, size // 2, mode="symmetric"), (size, size))
        return np.array([[f(np.concatenate([run_lengths(x) for x in lines(w)])) for w in row] for row in view])

    return run


def canny_like(low: float = 0.1, high: float = 0.2) -> Callable[[np.ndarray], np.ndarray]:
    """Edge strength classes of the Sobel magnitude: 1 strong, 0.5 weak, 0 none."""
    k = np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], float)

    def run(img: np.ndarray) -> np.ndarray:
        g = np.hypot(convolution(k)(img), convolution(k.T)(img))
        return np.where(g >= high, 1.0, np.where(g >= low, 0.5, 0.0))

    return run


def harris(k: float = 0.04) -> Callable[[np.ndarray], np.ndarray]:
    """Corner response of the gradient's second moments in 3 x 3 windows."""

    def run(img: np.ndarray) -> np.ndarray:
        gy, gx = np.gradient(img)
        mean = convolution(np.ones((3, 3)) / 9)
        a, b, c = mean(gx * gx), mean(gx * gy), mean(gy * gy)
        return a * c - b * b - k * (a + c) ** 2

    return run


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton of a 0/1 array by two-step parallel thinning."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        gone = 0
        for step in (0, 1):
            n = [m[r, c] for r, c in ((slice(0, -2), slice(1, -1)), (slice(0, -2), slice(2, None)), (slice(1, -1), slice(2, None)), (slice(2, None), slice(2, None)), (slice(2, None), slice(1, -1)), (slice(2, None), slice(0, -2)), (slice(1, -1), slice(0, -2)), (slice(0, -2), slice(0, -2)))]
            b = sum(x.astype(int) for x in n)
            a = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
            ok = (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0) if step == 0 else (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)
            drop = (m[1:-1, 1:-1] == 1) & (b >= 2) & (b <= 6) & (a == 1) & ok
            m[1:-1, 1:-1][drop] = 0
            gone += int(drop.sum())
        if not gone:
            return m[1:-1, 1:-1]


def skeleton(mask: DataFrame, halo: int = 32, tile: int = 512) -> DataFrame:
    """Skeleton of a 0/1 map (row, col, v) by tiles; exact for parts thinner than twice the halo."""
    return by_tile(mask, lambda a: thin(np.rint(a)), halo, tile)


def skeleton_points(skel: DataFrame) -> DataFrame:
    """length, endpoints (one neighbour) and junctions (three or more) of a skeleton."""
    from loamgrid.operators.stencil import box, spread

    on = skel.where("v = 1").select("row", "col")
    eight = [k for k in box(3) if k[:2] != (0, 0)]
    n = spread(on, eight, reflect=False, size=grid_size(skel)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    j = on.join(n, ["row", "col"], "left")
    return j.agg(F.count(F.lit(1)).alias("length"), F.sum((F.col("n") == 1).cast("long")).alias("endpoints"), F.sum((F.col("n") >= 3).cast("long")).alias("junctions"))
