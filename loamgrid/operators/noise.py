"""Noise reduction of cubes and single bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.functions import arrays as A
from loamgrid.operators import stencil as S


def _stripe_factors(x: DataFrame, axis: str) -> DataFrame:
    """band, axis, factor: lines whose mean is beyond two deviations are scaled to the mean of the
    neighbours at one and two lines' distance."""
    m = x.groupBy("band", axis).agg(F.avg("x").alias("m"))
    near = Window.partitionBy("band").orderBy(axis)
    whole = Window.partitionBy("band")
    around = F.array_compact(F.array(*(f("m", i).over(near) for f in (F.lag, F.lead) for i in (1, 2))))
    odd = F.abs(F.col("m") - F.avg("m").over(whole)) > 2 * F.stddev_pop("m").over(whole)
    s = m.withColumn("a", around).withColumn("odd", odd)
    return s.select("band", axis, F.when(F.col("odd") & (F.size("a") > 0) & (F.col("m") != 0), A.mean(F.col("a")) / F.col("m")).otherwise(1.0).alias("factor"))


def destripe(x: DataFrame) -> DataFrame:
    """(row, col, band, x) with columns, then rows, evened out."""
    for axis in ("col", "row"):
        x = x.join(_stripe_factors(x, axis), ["band", axis]).withColumn("x", F.col("x") * F.col("factor")).select("row", "col", "band", "x")
    return x


def fourier_destripe(x: DataFrame) -> DataFrame:
    """The same by damping the centre axes of each band's spectrum: one band is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = pdf.pivot(index="row", columns="col", values="x")
        f = np.fft.fftshift(np.fft.fft2(np.nan_to_num(img.to_numpy())))
        r, c = f.shape[0] // 2, f.shape[1] // 2
        f[max(0, r - 3) : r + 4, :] *= 0.1
        f[:, max(0, c - 3) : c + 4] *= 0.1
        out = np.real(np.fft.ifft2(np.fft.ifftshift(f)))
        # Gaps of the grid are filled for the transform only.
        return pdf[["row", "col", "band"]].assign(x=out[img.index.get_indexer(pdf["row"]), img.columns.get_indexer(pdf["col"])])

    return x.groupBy("band").applyInPandas(run, "row long, col long, band long, x double")


def remove_stripes(x: DataFrame, method: str = "statistical") -> DataFrame:
    """(row, col, band, x) without stripes; "wavelet" is the statistical method by another name."""
    if method not in ("statistical", "wavelet", "fourier"):
        raise ValueError(f"unknown method {method}")
    return fourier_destripe(x) if method == "fourier" else destripe(x)


def smooth_spectra(cube: DataFrame, method: str = "savgol", window: int = 5, order: int = 2, sigma: float = 1.0) -> DataFrame:
    a = F.col("spec")
    out: dict[str, Column] = {"savgol": A.savgol(a, window, order), "gaussian": A.convolve_reflect(a, A.gaussian_kernel(sigma)), "median": A.median_smooth(a, window), "moving_average": A.moving_average(a, window)}
    if method not in out:
        raise ValueError(f"unknown method {method}")
    return cube.withColumn("spec", out[method])


def remove_bad_bands(cube: DataFrame, waves: list[float], bad: list[int] | None = None) -> tuple[DataFrame, list[float]]:
    """The cube without bad bands, and the wavelengths that are left."""
    b = A.default_bad_bands(len(waves)) if bad is None else bad
    return cube.withColumn("spec", A.drop_bands(F.col("spec"), b)), A.drop_waves(waves, b)


def smooth_band(grid: DataFrame, method: str = "gaussian", sigma: float = 1.0, size: int = 3) -> DataFrame:
    """(row, col, v) smoothed in space: gaussian, median, uniform or wiener."""
    if method == "gaussian":
        return S.local(grid, S.gaussian(sigma), S.weighted().alias("v"))
    if method == "median":
        return S.local(grid, S.box(size), F.percentile("v", F.lit(0.5)).alias("v"))
    if method == "uniform":
        return S.local(grid, S.box(size), F.avg("v").alias("v"))
    if method == "wiener":
        s = S.local(grid, S.box(size), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
        noise = s.agg(F.avg("s2").alias("noise"))
        j = grid.join(s, ["row", "col"]).join(F.broadcast(noise))
        gain = F.when(F.col("s2") > F.col("noise"), (F.col("s2") - F.col("noise")) / F.col("s2")).otherwise(0.0)
        return j.select("row", "col", (F.col("m") + gain * (F.col("v") - F.col("m"))).alias("v"))
    raise ValueError(f"unknown method {method}")


def pca_denoise(cube: DataFrame, components: int, bands: int) -> DataFrame:
    """Spectra rebuilt from their first principal components, standardised per band."""
    x = cube.select("id", F.posexplode("spec").alias("b", "x"))
    s = x.groupBy("b").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")).agg(F.array_sort(F.collect_list(F.struct("b", "m", "sd"))).alias("s"))
    z = F.zip_with("spec", "s", lambda v, p: (v - p["m"]) / F.when(p["sd"] > 0, p["sd"]).otherwise(1.0))
    rows = cube.join(F.broadcast(s)).withColumn("x", array_to_vector(z))
    model = PCA(k=min(components, bands), inputCol="x", outputCol="y").fit(rows)
    pc = A.lit_array([]) if not bands else F.array(*(A.lit_array(r) for r in model.pc.toArray().tolist()))
    back = F.transform(pc, lambda r: A.dot(r, vector_to_array("y")))
    rebuilt = F.zip_with(back, "s", lambda v, p: v * F.when(p["sd"] > 0, p["sd"]).otherwise(1.0) + p["m"])
    return model.transform(rows).withColumn("spec", rebuilt).drop("x", "y", "s")


def noise_level(grid: DataFrame) -> DataFrame:
    """One row: Laplacian deviation over 6 in the middle half, and mean over it."""
    size = S.grid_size(grid)
    mid = lambda df: df.join(F.broadcast(size)).where("row >= floor(h / 4) and row < floor(3 * h / 4) and col >= floor(w / 4) and col < floor(3 * w / 4)")
    n = mid(S.laplace(grid)).agg((F.stddev_pop("laplace") / 6).alias("noise"))
    m = mid(grid).agg(F.avg("v").alias("mean"))
    out = n.join(F.broadcast(m))
    advice = F.when(F.col("noise") > 0.05, "strong denoising").when(F.col("noise") > 0.01, "moderate denoising").otherwise("no denoising needed")
    return out.withColumn("snr", F.try_divide("mean", "noise")).withColumn("advice", advice)


def apply_band_filter(x: DataFrame, f) -> DataFrame:
    """A caller's function of a 2-D array, applied to each band as one Arrow group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = pdf.pivot(index="row", columns="col", values="x")
        out = pd.DataFrame(f(img.to_numpy()), index=img.index, columns=img.columns).stack().rename("x").reset_index()
        return out.assign(band=pdf["band"].iloc[0])[["row", "col", "band", "x"]]

    return x.groupBy("band").applyInPandas(run, "row long, col long, band long, x double")
