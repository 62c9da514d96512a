"""Radiometric calibration and atmospheric correction of a cube.

Per-band constants are worked out once on the driver and enter the plan as literal arrays; scene
statistics are one aggregation joined back as a single row.  Everything else is one projection.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.arrays import lit_array
from loamgrid.functions.quantiles import percentiles

#: Solar irradiance (W/m2/nm) at 400, 450, ... 2500 nm.
SOLAR = [
    1.87, 1.94, 1.99, 1.97, 1.89, 1.86, 1.82, 1.78, 1.74, 1.69, 1.64, 1.58, 1.52, 1.46, 1.40, 1.33, 1.27, 1.20, 1.13, 1.06, 0.99, 0.92,
    0.85, 0.78, 0.71, 0.64, 0.57, 0.50, 0.43, 0.36, 0.29, 0.22, 0.15, 0.08, 0.05, 0.03, 0.02, 0.01, 0.008, 0.006, 0.004, 0.002, 0.001,
]
#: Angstrom exponents by aerosol model (others: 1.3).
ANGSTROM = {"urban": 1.3, "rural": 1.5, "maritime": 0.5}
#: Water vapour bands (nm) and their strengths.
WATER_BANDS = {940: 0.1, 1140: 0.08, 1380: 0.15, 1900: 0.12, 2700: 0.2}


def solar_irradiance(waves: list[float]) -> list[float]:
    """Linear between the table's knots, extrapolated beyond them, at least 0.001."""
    out = []
    for w in waves:
        i = min(max(int((w - 400) // 50), 0), len(SOLAR) - 2)
        out.append(max(SOLAR[i] + (SOLAR[i + 1] - SOLAR[i]) * (w - 400 - 50 * i) / 50, 0.001))
    return out


def sun_elevation(meta: dict) -> float:
    for key in ("sun_elevation", "solar_elevation"):
        if meta.get(key) is not None:
            return float(meta[key])
    return 90.0 - float(meta["sun_zenith"]) if meta.get("sun_zenith") is not None else 45.0


def earth_sun_distance(meta: dict) -> float:
    """Given, else from the day of the year of ``acquisition_date``, else 1."""
    if meta.get("earth_sun_distance") is not None:
        return float(meta["earth_sun_distance"])
    if meta.get("acquisition_date"):
        day = date.fromisoformat(str(meta["acquisition_date"])).timetuple().tm_yday
        return distance_of_day(day)
    return 1.0


def distance_of_day(day: int) -> float:
    return 1 - 0.01672 * math.cos(2 * math.pi * (day - 1) / 365.25)


def gains_offsets(bands: int, meta: dict, scale: float = 1e-4, offset: float = 0.0) -> tuple[list[float], list[float]]:
    given = meta.get("calibration") or {}
    gains, offsets = list(given.get("gains", [])), list(given.get("offsets", []))
    return (gains, offsets) if len(gains) == len(offsets) == bands else ([scale] * bands, [offset] * bands)


def _clip(x: Column, low: float, high: float | None = None) -> Column:
    x = F.greatest(F.lit(low), x)
    return x if high is None else F.least(F.lit(high), x)


def _linear(spec: str, a: list[float], b: list[float], low: float | None = None, high: float | None = None) -> Column:
    """spec * a + b for each band, clipped where asked."""
    pairs = F.arrays_zip(F.col(spec).alias("x"), lit_array(a).alias("a"), lit_array(b).alias("b"))
    return F.transform(pairs, lambda t: t["x"] * t["a"] + t["b"] if low is None else _clip(t["x"] * t["a"] + t["b"], low, high))


def gain_offset(cube: DataFrame, gains: list[float], offsets: list[float]) -> DataFrame:
    return cube.withColumn("spec", _linear("spec", gains, offsets))


def to_radiance(cube: DataFrame, bands: int, meta: dict) -> DataFrame:
    """DN times gain plus offset, at least 0."""
    gains, offsets = gains_offsets(bands, meta)
    return cube.withColumn("spec", _linear("spec", gains, offsets, 0.0))


def to_toa(cube: DataFrame, waves: list[float], meta: dict) -> DataFrame:
    """Top-of-atmosphere reflectance within 0..1.2; 0 where the sun is down."""
    cos = math.cos(math.radians(90.0 - sun_elevation(meta)))
    d2 = earth_sun_distance(meta) ** 2
    factor = [math.pi * d2 / (e * cos) if cos > 0 and e > 0 else 0.0 for e in solar_irradiance(waves)]
    return to_radiance(cube, len(waves), meta).withColumn("spec", _linear("spec", factor, [0.0] * len(waves), 0.0, 1.2))


def simple_atmosphere(waves: list[float]) -> tuple[list[float], list[float]]:
    path = [0.05 * math.exp(-w / 1000) for w in waves]
    through = [min(max(0.8 + 0.15 * math.exp(-((w - 800) ** 2) / 80000), 0.3), 0.95) for w in waves]
    return path, through


def to_boa(cube: DataFrame, waves: list[float], meta: dict) -> DataFrame:
    """Surface reflectance by a simple atmosphere, within 0..1."""
    path, through = simple_atmosphere(waves)
    return to_toa(cube, waves, meta).withColumn("spec", _linear("spec", [1 / t for t in through], [-p / t for p, t in zip(path, through, strict=True)], 0.0, 1.0))


def calibrate(cube: DataFrame, waves: list[float], meta: dict, method: str = "TOA", enabled: bool = True) -> DataFrame:
    if not enabled:
        return cube
    if method == "RAD":
        return to_radiance(cube, len(waves), meta)
    return to_boa(cube, waves, meta) if method == "BOA" else to_toa(cube, waves, meta)


def by_band(cube: DataFrame, *keep: str) -> DataFrame:
    """(band, x): one row for each pixel and band."""
    return cube.select(*keep, F.posexplode("spec").alias("band", "x"))


def estimate_gains(cube: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """band, gain, offset: least squares against reference spectra of the same pixels (more than
    100 of them, else 1e-4 and 0), or without reference a stretch of 0.8."""
    if reference is None:
        s = by_band(cube).groupBy("band").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        gain = 0.8 / (F.col("high") - F.col("low") + 1e-10)
        return s.select("band", gain.alias("gain"), (-F.col("low") * gain).alias("offset"))
    pairs = cube.select("id", F.col("spec").alias("s")).join(reference.select("id", F.col("spec").alias("r")), "id")
    rows = pairs.select(F.posexplode(F.arrays_zip("s", "r")).alias("band", "p")).select("band", "p.s", "p.r").where(~F.isnan("s") & ~F.isnan("r") & (F.col("s") > 0))
    fit = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("r", "s").alias("gain"), F.regr_intercept("r", "s").alias("offset"))
    enough = F.col("n") > 100
    return fit.select("band", F.when(enough, F.col("gain")).otherwise(1e-4).alias("gain"), F.when(enough, F.col("offset")).otherwise(0.0).alias("offset"))


def scene_statistics(cube: DataFrame) -> DataFrame:
    """band, mean, std (population), min, max, p1, p99."""
    x = by_band(cube)
    s = x.groupBy("band").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return s.join(percentiles(x, ["band"], "x", [0.01, 0.99]), "band").select("band", "mean", "std", "min", "max", F.get("q", F.lit(0)).alias("p1"), F.get("q", F.lit(1)).alias("p99"))


# Atmospheric correction.


def estimated_transmittance(w: float) -> float:
    water = sum(0.1 * math.exp(-((w - b) ** 2) / 800) for b in WATER_BANDS if abs(w - b) < 50)
    return max(0.85 - water - 0.05 * (400 / w) ** 4 - 0.02 * (550 / w) ** 1.3, 0.3)


def _band_row(stats: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: a per-band value as an array in band order."""
    ordered = F.array_sort(F.collect_list(F.struct("band", value.alias("v"))))
    return stats.agg(F.transform(ordered, lambda t: t["v"]).alias(name))


def relative_azimuth(meta: dict) -> float:
    """Degrees between the sun's and the sensor's azimuth; 0 where either is unknown."""
    a, b = meta.get("sun_azimuth"), meta.get("view_azimuth")
    return abs(a - b) if a is not None and b is not None else 0.0


def dark_object(cube: DataFrame, waves: list[float], percentile: float = 0.01) -> DataFrame:
    """Dark object subtraction: per-band means of the darkest pixels of band 50 (or the last) give
    the path radiance, with the Rayleigh level as its floor."""
    band = F.element_at("spec", 51 if len(waves) > 50 else -1)
    limit = percentiles(cube.select(band.alias("x")), [], "x", [percentile]).select(F.get("q", F.lit(0)).alias("limit"))
    dark = cube.join(F.broadcast(limit)).where(band <= F.col("limit"))
    level = _band_row(by_band(dark).groupBy("band").agg(F.avg("x").alias("m")), F.col("m"), "dark")
    floor, through = lit_array([0.001 * (550 / w) ** 4 for w in waves]), lit_array([estimated_transmittance(w) for w in waves])
    t = F.arrays_zip(F.col("spec").alias("x"), F.col("dark").alias("d"), floor.alias("f"), through.alias("t"))
    fixed = F.transform(t, lambda z: _clip((z["x"] - F.greatest(z["d"], z["f"])) / z["t"], 0.0, 1.0))
    return cube.join(F.broadcast(level)).withColumn("spec", fixed).drop("dark")


def quick_stretch(cube: DataFrame) -> DataFrame:
    """Each band stretched by 0.6 of its range from its minimum, within 0..1; constant bands stay."""
    s = by_band(cube).groupBy("band").agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("v"))
    row = _band_row(s, F.col("v"), "ranges")
    fixed = F.zip_with("spec", "ranges", lambda x, v: F.when(v["high"] > v["low"], _clip((x - v["low"]) * 0.6 / (v["high"] - v["low"]), 0.0, 1.0)).otherwise(_clip(x, 0.0, 1.0)))
    return cube.join(F.broadcast(row)).withColumn("spec", fixed).drop("ranges")


def water_absorption(w: float, vapour: float) -> float:
    return sum(s * vapour * math.exp(-((w - b) ** 2) / 1800) for b, s in WATER_BANDS.items() if abs(w - b) < 100)


def aerosol_extinction(w: float, model: str, visibility: float) -> float:
    return 3.91 / visibility * (550 / w) ** ANGSTROM.get(model, 1.3)


def transmittance(w: float, vapour: float, model: str, visibility: float, sun_zenith: float, view_zenith: float) -> float:
    path = (1 / math.cos(math.radians(sun_zenith)) + 1 / math.cos(math.radians(view_zenith))) / 2
    return max(0.85 - path * (water_absorption(w, vapour) + aerosol_extinction(w, model, visibility) + 0.05 * (400 / w) ** 4), 0.1)


def path_radiance(w: float, visibility: float, sun_zenith: float) -> float:
    scatter = 0.02 * (400 / w) ** 4 + 0.01 * (550 / w) ** 1.3 * (23 / visibility)
    return max(scatter * 0.5 / math.cos(math.radians(sun_zenith)), 0.001)


def spherical_albedo(w: float, visibility: float) -> float:
    return min(0.05 + 0.02 * (23 / visibility) * (550 / w) ** 0.5, 0.2)


def zeniths(meta: dict) -> tuple[float, float, float]:
    """Sun zenith, view zenith, relative azimuth."""
    sun = float(meta["sun_zenith"]) if meta.get("sun_zenith") is not None else 90 - float(meta["sun_elevation"]) if meta.get("sun_elevation") is not None else 45.0
    azimuth = abs(float(meta.get("sun_azimuth") or 0) - float(meta.get("view_azimuth") or 0))
    return sun, float(meta.get("view_zenith") or 0), azimuth


def flaash(cube: DataFrame, waves: list[float], meta: dict, vapour: float = 2.5, model: str = "rural", visibility: float = 40.0) -> DataFrame:
    sun, view, _ = zeniths(meta)
    t = [transmittance(w, vapour, model, visibility, sun, view) for w in waves]
    p = [path_radiance(w, visibility, sun) for w in waves]
    s = [spherical_albedo(w, visibility) for w in waves]
    z = F.arrays_zip(F.col("spec").alias("x"), lit_array(t).alias("t"), lit_array(p).alias("p"), lit_array(s).alias("s"))
    return cube.withColumn("spec", F.transform(z, lambda b: _clip((b["x"] - b["p"]) / F.greatest(b["t"] + b["s"] * (b["x"] - b["p"]), F.lit(0.01)), 0.0, 1.0)))


def sixs_coefficients(w: float, aod: float, sun_zenith: float, view_zenith: float) -> tuple[float, float, float]:
    xb = math.exp(-aod / math.cos(math.radians(sun_zenith))) * math.exp(-aod / math.cos(math.radians(view_zenith)))
    s = 0.05 + 0.02 * aod
    return 0.01 * aod * (550 / w) ** 1.3, xb, s / (1 - s)


def optical_depth(visibility: float = 40.0) -> float:
    return max(3.91 / visibility, 0.05)


def sixs(cube: DataFrame, waves: list[float], meta: dict, visibility: float = 40.0) -> DataFrame:
    sun, view, _ = zeniths(meta)
    k = [sixs_coefficients(w, optical_depth(visibility), sun, view) for w in waves]
    z = F.arrays_zip(F.col("spec").alias("x"), *(lit_array(c).alias(n) for n, c in zip("abc", zip(*k, strict=True), strict=True)))
    return cube.withColumn("spec", F.transform(z, lambda b: _clip((b["x"] - b["a"]) / F.greatest(b["b"] + b["c"] * b["x"], F.lit(0.01)), 0.0, 1.0)))


def correct_atmosphere(cube: DataFrame, waves: list[float], meta: dict, method: str = "DOS", **kw) -> DataFrame:
    if method == "FLAASH":
        return flaash(cube, waves, meta, **kw)
    if method == "QUAC":
        return quick_stretch(cube)
    return sixs(cube, waves, meta, **kw) if method == "6SV" else dark_object(cube, waves)


def correction_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Means, ranges and issues of a correction, as one row."""
    stat = lambda df, tag: by_band(df).agg(F.avg("x").alias(f"mean_{tag}"), F.stddev_pop("x").alias(f"std_{tag}"), F.min("x").alias(f"min_{tag}"), F.max("x").alias(f"max_{tag}"))
    both = stat(before, "before").crossJoin(F.broadcast(stat(after, "after")))  # two single rows
    issues = F.array_compact(
        F.array(
            F.when(F.abs(F.col("mean_after") - F.col("mean_before")) > 0.1, F.lit("large mean change")),
            F.when(F.col("min_after") < 0, F.lit("negative values")),
            F.when(F.col("max_after") > 1, F.lit("values above 1")),
        )
    )
    quality = F.when(F.size("issues") == 0, "Good").when(F.size("issues") <= 2, "Acceptable").otherwise("Poor")
    return both.withColumn("issues", issues).withColumn("quality", quality)
