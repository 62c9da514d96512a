"""Spectral indices of a pixel as Column expressions, each within whole-stage code generation.

Three templates cover most: a normalised difference (0 on a zero sum, clipped to -1..1), a ratio
less a constant (0 on a zero denominator), and soil-adjusted forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.scene import Bands

Index = Callable[[Bands], Column]


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, clip((a - b) / (a + b), -1.0, 1.0)).otherwise(0.0)


def ratio(a: Column, b: Column, less: float = 0.0) -> Column:
    return F.when(b != 0, a / b - less).otherwise(0.0)


def guarded(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def _nd(a: str | float, b: str | float) -> Index:
    return lambda k: normalised_difference(k.col(a), k.col(b))


def _ratio(a: str, b: str, less: float = 0.0) -> Index:
    return lambda k: ratio(k.col(a), k.col(b), less)


def _savi(adjust: float) -> Index:
    return lambda k: guarded(k.col("nir") - k.col("red"), k.col("nir") + k.col("red") + adjust) * (1 + adjust)


def _evi(k: Bands) -> Column:
    n, r, b = k.col("nir"), k.col("red"), k.col("blue")
    den = n + 6 * r - 7.5 * b + 1
    return F.when(den != 0, clip(2.5 * (n - r) / den, -1.0, 1.0)).otherwise(0.0)


def _msavi(k: Bands) -> Column:
    n, r = k.col("nir"), k.col("red")
    return (2 * n + 1 - F.sqrt(F.greatest((2 * n + 1) * (2 * n + 1) - 8 * (n - r), F.lit(0.0)))) / 2


def _mcari(k: Bands) -> Column:
    e, r, g = k.col("red_edge"), k.col("red"), k.col("green")
    return ((e - r) - 0.2 * (e - g)) * guarded(e, r)


def _tcari(k: Bands) -> Column:
    e, r, g = k.col("red_edge"), k.col("red"), k.col("green")
    return 3 * ((e - r) - 0.2 * (e - g) * guarded(e, r))


def _rep(k: Bands) -> Column:
    """Wavelength of the steepest rise between red and near infrared (the first on ties)."""
    first, last = k.index("red"), k.index("nir")
    n = last - first  # the region ends before the near infrared band
    part = F.slice("spec", first + 1, n)
    rise = F.zip_with(F.slice(part, 2, n - 1), F.slice(part, 1, n - 1), lambda b, a: b - a)
    at = F.array_position(rise, F.array_max(rise)) - 1
    return F.lit(k.waves[first]) + at * F.lit((k.waves[last - 2] - k.waves[first]) / (n - 1))


def _arvi(k: Bands) -> Column:
    rb = 2 * k.col("red") - k.col("blue")
    return normalised_difference(k.col("nir"), rb)


def _gemi(k: Bands) -> Column:
    n, r = k.col("nir"), k.col("red")
    eta = guarded(2 * (n * n - r * r) + 1.5 * n + 0.5 * r, n + r + 0.5)
    return eta * (1 - 0.25 * eta) - guarded(r - 0.125, 1 - r)


def _tsavi(k: Bands) -> Column:
    n, r = k.col("nir"), k.col("red")
    return guarded(n - r, n + r + 0.16)


INDICES: dict[str, Index] = {
    "ndvi": _nd("nir", "red"),
    "evi": _evi,
    "savi": _savi(0.5),
    "osavi": _savi(0.16),
    "msavi": _msavi,
    "gesavi": _savi(0.5),
    "ndwi": _nd("green", "nir"),
    "mndwi": _nd("green", "swir1"),
    "ndmi": _nd("nir", "swir1"),
    "wbi": _ratio("red", "nir"),
    "msi": _ratio("swir1", "nir"),
    "lswi": _nd("nir", "swir1"),
    "mcari": _mcari,
    "tcari": _tcari,
    "chl": _ratio("red_edge", "red", 1.0),
    "ci": _ratio("nir", "red", 1.0),
    "cig": _ratio("nir", "green", 1.0),
    "rep": _rep,
    "ndre": _nd("nir", "red_edge"),
    "mndre": _nd("red_edge_740", "red_edge_705"),
    "ci_red_edge": _ratio("nir", "red_edge", 1.0),
    "mtci": lambda k: guarded(k.col("red_edge_740") - k.col("red_edge_705"), k.col("red_edge_705") - k.col("red")),
    "pri": _nd(531.0, 570.0),
    "sipi": lambda k: F.try_divide(k.col(800.0) - k.col(445.0), k.col(800.0) + k.col(680.0)),
    "npci": _nd("red", "blue"),
    "pri_ci": lambda k: INDICES["pri"](k) * INDICES["ci"](k),
    "arvi": _arvi,
    "gemi": _gemi,
    "vari": lambda k: guarded(k.col("green") - k.col("red"), k.col("green") + k.col("red") - k.col("blue")),
    "gndvi": _nd("nir", "green"),
    "tsavi": _tsavi,
    "atsavi": _tsavi,
    "tndvi": lambda k: F.sqrt(INDICES["ndvi"](k) + 0.5),
    "dvi": lambda k: k.col("nir") - k.col("red"),
    "ipvi": lambda k: guarded(k.col("nir"), k.col("nir") + k.col("red")),
    "rvi": _ratio("nir", "red"),
    "tvi": lambda k: 0.5 * (120 * (k.col("nir") - k.col("green")) - 200 * (k.col("red") - k.col("green"))),
}

#: What each index stands for.
DESCRIPTIONS = {
    "ndvi": "normalised difference vegetation", "evi": "enhanced vegetation", "savi": "soil-adjusted vegetation",
    "osavi": "optimised soil-adjusted vegetation", "msavi": "modified soil-adjusted vegetation", "gesavi": "generalised soil-adjusted vegetation",
    "ndwi": "normalised difference water", "mndwi": "modified normalised difference water", "ndmi": "normalised difference moisture",
    "wbi": "water band", "msi": "moisture stress", "lswi": "land surface water", "mcari": "modified chlorophyll absorption ratio",
    "tcari": "transformed chlorophyll absorption ratio", "chl": "chlorophyll", "ci": "chlorophyll index", "cig": "chlorophyll index green",
    "rep": "red-edge position", "ndre": "normalised difference red edge", "mndre": "modified normalised difference red edge",
    "ci_red_edge": "chlorophyll index red edge", "mtci": "terrestrial chlorophyll", "pri": "photochemical reflectance",
    "sipi": "structure-insensitive pigment", "npci": "normalised pigment chlorophyll", "pri_ci": "pigment product",
    "arvi": "atmospherically resistant vegetation", "gemi": "global environment monitoring", "vari": "visible atmospherically resistant",
    "gndvi": "green normalised difference vegetation", "tsavi": "transformed soil-adjusted vegetation", "atsavi": "adjusted transformed soil-adjusted vegetation",
    "tndvi": "transformed normalised difference vegetation", "dvi": "difference vegetation", "ipvi": "infrared percentage vegetation",
    "rvi": "ratio vegetation", "tvi": "triangular vegetation",
}


def calculate(cube, bands: Bands, names: list[str] | None = None, keep: tuple[str, ...] = ("id", "row", "col")):
    """Chosen index columns (all by default; unknown names are skipped) beside the key columns."""
    chosen = [n for n in (names or list(INDICES)) if n in INDICES]
    return cube.select(*(c for c in keep if c in cube.columns), *(INDICES[n](bands).alias(n) for n in chosen))


def describe(name: str) -> str:
    return DESCRIPTIONS.get(name.lower(), "unknown index")
