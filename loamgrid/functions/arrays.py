"""Spectrum functions: array columns in, array or scalar columns out, all JVM-side.

Statistics are population statistics; percentiles interpolate linearly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.scene import FEATURE_NM, nearest_band


def lit_array(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column) -> Column:
    """Population variance in two passes."""
    return F.when(F.size(a) > 0, let(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a)))


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def quantile(a: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array without nulls."""
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(a) - 1)
    return let(F.array_sort(a), lambda s: F.element_at(s, low + 1) + (F.element_at(s, high + 1) - F.element_at(s, low + 1)) * (at - low))


def diff(a: Column) -> Column:
    """Differences of neighbours; one shorter."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda y, x: y - x)


def first_derivative(a: Column, waves: list[float] | None = None) -> Column:
    """Differences, by wavelength where one is given for each band."""
    if waves is None:
        return diff(a)
    steps = lit_array([b - c for b, c in zip(waves[1:], waves[:-1], strict=True)])
    return F.zip_with(diff(a), steps, lambda d, w: d / w)


def second_derivative(a: Column, waves: list[float] | None = None) -> Column:
    """Differences of the first derivative, not divided again."""
    return diff(first_derivative(a, waves))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def slope(a: Column) -> Column:
    """Least-squares slope against the band number."""
    n = F.size(a)
    mid = (n - 1) / 2.0
    cov = total(F.transform(a, lambda x, i: (i - mid) * x))
    return F.when(n > 1, cov / (n * (n * n - 1) / 12.0)).otherwise(0.0)


def statistics(a: Column) -> dict[str, Column]:
    """The ten statistics of a spectrum, by name."""
    m, s, low, high, q25, q75 = mean(a), std(a), F.array_min(a), F.array_max(a), quantile(a, 0.25), quantile(a, 0.75)
    return {"mean": m, "std": s, "min": low, "max": high, "range": high - low, "q25": q25, "q75": q75, "iqr": q75 - q25, "cv": s / (m + 1e-10), "slope": slope(a)}


def spectral_angle(a: Column, reference: list[float]) -> Column:
    """Angle to a reference spectrum; pi where fewer than two bands or a zero norm."""
    ref = lit_array(reference)
    norm = F.sqrt(dot(a, a)) * math.sqrt(sum(r * r for r in reference))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, ref) / norm))
    return F.when((F.size(a) > 1) & (norm > 0), F.acos(cos)).otherwise(F.lit(math.pi))


def reference_spectra(bands: int) -> dict[str, list[float]]:
    """Water, vegetation and soil references over the quarters of the band range.

    Fixed values: the levels of each quarter; soil rises evenly.
    """
    levels = {"water": (0.8, 0.6, 0.1, 0.1), "vegetation": (0.4, 0.3, 0.8, 0.6)}
    cuts = (bands // 4, bands // 2, 3 * bands // 4)
    out = {name: [v[sum(i >= c for c in cuts)] for i in range(bands)] for name, v in levels.items()}
    return out | {"soil": [0.2 + 0.2 * i / (bands - 1) if bands > 1 else 0.2 for i in range(bands)]}


def end_line_continuum(a: Column) -> Column:
    """Spectrum over the straight line between its ends."""
    n = F.size(a)
    first, last = F.element_at(a, 1), F.element_at(a, -1)
    return F.when(n > 1, F.transform(a, lambda x, i: x / F.greatest(first + (last - first) * i / (n - 1), F.lit(1e-10)))).otherwise(a)


def moving_average(a: Column, window: int) -> Column:
    """Centred means; windows shrink at the ends; a window of the whole length leaves it alone."""
    half = window // 2
    n = F.size(a)

    def around(x: Column, i: Column) -> Column:
        low, high = F.greatest(i - half, F.lit(0)), F.least(i + half, n - 1)
        part = F.slice(a, low + 1, high - low + 1)
        return total(part) / F.size(part)

    return F.when(n <= window, a).otherwise(F.transform(a, around))


def convolve_reflect(a: Column, kernel: list[float]) -> Column:
    """Same-length correlation with a symmetric kernel, edges mirrored with the edge band doubled."""
    half, n = len(kernel) // 2, F.size(a)

    def at(i: Column) -> Column:
        return F.element_at(a, F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i) + 1)

    def value(x: Column, i: Column) -> Column:
        out = F.lit(0.0)
        for k, w in enumerate(kernel):
            out = out + at(i + (k - half)) * w
        return out

    return F.transform(a, value)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def savgol_kernel(window: int, order: int) -> list[list[float]]:
    """Savitzky-Golay smoothing as a (window x window) projection: row i gives the value at i."""
    import numpy as np

    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return (x @ np.linalg.pinv(x)).tolist()


def savgol(a: Column, window: int = 5, order: int = 2) -> Column:
    """Savitzky-Golay smoothing; the first and last half window come from the end windows' fits."""
    rows, half, n = savgol_kernel(window, order), window // 2, F.size(a)
    weights = F.array(*(lit_array(r) for r in rows))

    def value(x: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), F.least(i - half, n - window))
        return dot(F.slice(a, first + 1, window), F.element_at(weights, i - first + 1))

    return F.when(n < window, a).otherwise(F.transform(a, value))


def median_smooth(a: Column, window: int) -> Column:
    """Running median, edges padded with zeros."""
    half, n = window // 2, F.size(a)
    around = lambda i: F.transform(F.sequence(i - half, i + half), lambda j: F.when((j < 0) | (j >= n), 0.0).otherwise(F.element_at(a, F.greatest(F.lit(0), F.least(j, n - 1)) + 1)))
    return F.transform(a, lambda x, i: F.element_at(F.array_sort(around(i)), half + 1))


def despike(a: Column) -> Column:
    """Replace a band by its neighbours' mean where it jumps up and down (or down and up) by more
    than three standard deviations of the differences; spectra under five bands stay."""
    n = F.size(a)

    def clean(d: Column) -> Column:
        def fix(limit: Column):
            def one(x: Column, i: Column) -> Column:
                inside = (i >= 1) & (i <= n - 2)
                left = F.element_at(d, F.greatest(i, F.lit(1)))
                right = F.element_at(d, F.least(i + 1, n - 1))
                spike = (F.abs(left) > limit) & (F.abs(right) > limit) & (left * right < 0)
                between = (F.element_at(a, F.greatest(i, F.lit(1))) + F.element_at(a, F.least(i + 2, n))) / 2
                return F.when(inside & spike, between).otherwise(x)

            return F.transform(a, one)

        return let(std(d) * 3, fix)

    return F.when(n < 5, a).otherwise(let(diff(a), clean))


def drop_bands(a: Column, bad: list[int]) -> Column:
    """The spectrum without bad bands; drop their wavelengths with :func:`drop_waves`."""
    out = set(bad)
    return F.filter(a, lambda x, i: ~i.isin(*out)) if out else a


def drop_waves(waves: list[float], bad: list[int]) -> list[float]:
    return [w for i, w in enumerate(waves) if i not in set(bad)]


def default_bad_bands(bands: int) -> list[int]:
    """The first four bands and 104-223, where the sensor is noisy."""
    return [i for i in [*range(4), *range(104, 224)] if i < bands]


def spectral_features(a: Column, waves: list[float]) -> dict[str, Column]:
    """Red-edge position (as a band offset), green-red slope and the 1600 nm water absorption."""
    at = {k: nearest_band(waves, v) for k, v in FEATURE_NM.items()}
    band = lambda name: F.element_at(a, at[name] + 1)
    region = F.slice(a, at["red"] + 1, max(at["nir"] - at["red"], 1))
    rise = diff(region)
    return {
        "red_edge_position": (F.array_position(rise, F.array_max(rise)) - 1 + at["red"]).cast("double"),
        "green_red_slope": (band("red") - band("green")) / max(at["red"] - at["green"], 1),
        "water_absorption_1600": band("nir") - band("swir1"),
    }


def absorption_windows(waves: list[float]) -> list[tuple[int, int]]:
    """Band ranges of five absorption features.  Fixed values: centre and half width in nm."""
    centres = [(940, 25), (1450, 50), (1940, 50), (2200, 50), (2350, 50)]
    return [(nearest_band(waves, c - h), nearest_band(waves, c + h)) for c, h in centres]


def absorption(a: Column, low: int, high: int) -> dict[str, Column]:
    """Depth, width and relative position of an absorption under its end-to-end continuum."""
    n = high - low + 1
    if n < 3:
        return {"depth": F.lit(0.0), "width": F.lit(0.0), "position": F.lit(0.0)}
    deep = F.transform(end_line_continuum(F.slice(a, low + 1, n)), lambda x: 1 - x)
    depth = F.array_max(deep)
    return {"depth": depth, "width": F.size(F.filter(deep, lambda x: x > 0.1)).cast("double"), "position": (F.array_position(deep, depth) - 1) / float(n)}
