"""Fields on a latitude-longitude grid: axes, wavenumbers, tapers, padding, pooling, comparison of two fields.

A field is a table (y, x, value).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratascope.functions import geometry


def latitude(y: Column, first: float, step: float) -> Column:
    return F.lit(first) + y * step


def longitude(x: Column, first: float, step: float) -> Column:
    return F.pmod(F.lit(first) + x * step, F.lit(360.0))


def wavenumber(i: Column, n: int, spacing: float = 1.0) -> Column:
    """The signed frequency of the i-th Fourier coefficient, in cycles per unit of ``spacing``."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * spacing)


def nyquist(spacing: float) -> float:
    return 1 / (2 * spacing)


def with_geometry(field: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """``field`` with lat, lon, dx_metres, area_km2, weight (the cell's share of all area) and aspect (dy over dx)."""
    lat = latitude(F.col("y"), lat0, dlat)
    out = field.withColumn("lat", lat).withColumn("lon", longitude(F.col("x"), lon0, dlon)).withColumn("dx_metres", geometry.dx_metres(lat, dlon)).withColumn("area_km2", geometry.cell_area(lat, dlat, dlon))
    total = out.agg(F.sum("area_km2").alias("total"))
    aspect = geometry.dy_metres(dlat) / F.col("dx_metres")
    return out.crossJoin(F.broadcast(total)).withColumn("weight", F.col("area_km2") / F.col("total")).withColumn("aspect", aspect).drop("total")


def with_wavenumbers(field: DataFrame, height: int, width: int) -> DataFrame:
    """``field``, its cells read as Fourier coefficients, with ky, kx and k in cycles a cell."""
    out = field.withColumn("ky", wavenumber(F.col("y"), height)).withColumn("kx", wavenumber(F.col("x"), width))
    return out.withColumn("k", F.sqrt(F.col("ky") * F.col("ky") + F.col("kx") * F.col("kx")))


def taper(i: Column, n: int, kind: str, alpha: float = 0.5) -> Column:
    """Symmetric window of n places: hann, hamming or tukey with a tapered share of ``alpha``."""
    if n < 2:
        return F.lit(1.0)
    turn = F.cos(2 * math.pi * i / (n - 1))
    if kind == "hann":
        return 0.5 - 0.5 * turn
    if kind == "hamming":
        return 0.54 - 0.46 * turn
    edge = alpha * (n - 1) / 2
    near = F.least(i, F.lit(n - 1) - i)
    return F.when(near >= edge, 1.0).otherwise(0.5 * (1 + F.cos(math.pi * (near / edge - 1)))) if edge > 0 else F.lit(1.0)


def tapered(field: DataFrame, height: int, width: int, kind: str, alpha: float = 0.5) -> DataFrame:
    return field.withColumn("value", F.col("value") * taper(F.col("y"), height, kind, alpha) * taper(F.col("x"), width, kind, alpha))


def _source(i: Column, n: int, treatment: str) -> Column:
    """The place that a padded place i (below 0 or beyond n - 1) is taken from; null for zero."""
    if treatment == "periodic":
        return F.pmod(i, F.lit(n))
    if treatment == "replicate":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if treatment == "reflect":
        back = F.pmod(i, F.lit(max(1, 2 * n - 2)))
        return F.least(back, F.lit(2 * n - 2) - back)
    return F.when((i >= 0) & (i < n), i)


def padded(field: DataFrame, height: int, width: int, pad: int, treatment: str) -> DataFrame:
    """y, x, value from -pad on: the edge is periodic, replicate, reflect (without repeating the edge) or zero."""
    rows = field.sparkSession.range(-pad, height + pad).select(F.col("id").alias("y"), _source(F.col("id"), height, treatment).alias("from_y"))
    cols = field.sparkSession.range(-pad, width + pad).select(F.col("id").alias("x"), _source(F.col("id"), width, treatment).alias("from_x"))
    cells = rows.crossJoin(F.broadcast(cols)).join(field.select(F.col("y").alias("from_y"), F.col("x").alias("from_x"), "value"), ["from_y", "from_x"], "left")
    return cells.select("y", "x", F.coalesce("value", F.lit(0.0)).alias("value") if treatment == "zero" else "value")


def pooled(field: DataFrame, down: int, across: int) -> DataFrame:
    """y, x, n, value: means over blocks of cells."""
    return field.groupBy(F.floor(F.col("y") / down).alias("y"), F.floor(F.col("x") / across).alias("x")).agg(F.count("value").alias("n"), F.avg("value").alias("value"))


def noisy(field: DataFrame, level: float, seed: int) -> DataFrame:
    """``field`` with evenly distributed noise between -level and level, from a hash of seed and place."""
    from stratascope.operators.nulls import drawn

    return field.withColumn("value", F.col("value") + level * (2 * drawn(F.lit(seed), F.col("y"), F.col("x")) / float(1 << 48) - 1))


def spherical_laplacian(field: DataFrame, lat: Column, dlat: float, dlon: float, radius: float = geometry.EARTH_KM * 1000) -> DataFrame:
    """y, x, laplacian in flux form where all four neighbours are there: meridional fluxes carry the cosine of the half latitude."""
    cells = field.withColumn("lat", lat)
    at = lambda dy, dx, name: field.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("value").alias(name))
    out = cells.join(at(1, 0, "n"), ["y", "x"]).join(at(-1, 0, "s"), ["y", "x"]).join(at(0, 1, "e"), ["y", "x"]).join(at(0, -1, "w"), ["y", "x"])
    cos = lambda c: F.cos(F.radians(c))
    a, b = math.radians(dlat), math.radians(dlon)
    north, south = cos(F.col("lat") + dlat / 2) * (F.col("n") - F.col("value")), cos(F.col("lat") - dlat / 2) * (F.col("value") - F.col("s"))
    along = (F.col("e") - 2 * F.col("value") + F.col("w")) / (b * b * cos(F.col("lat")) * cos(F.col("lat")))
    return out.select("y", "x", (((north - south) / (a * a * cos(F.col("lat"))) + along) / (radius * radius)).alias("laplacian"))


def likeness(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mse, rmse, psnr and ssim of (truth, forecast), over the range of the truth, which counts as 1 where it is 0.

    ssim takes the covariance over n and the variances over n - 1, and is null for a single pair; psnr adds 1e-8 to rmse.
    """
    t, f = F.col("truth"), F.col("forecast")
    g = pairs.where(t.isNotNull() & f.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((f - t) * (f - t)).alias("mse"), (F.max(t) - F.min(t)).alias("range"), F.avg(t).alias("mt"), F.avg(f).alias("mf"), F.var_samp(t).alias("vt"), F.var_samp(f).alias("vf"), F.covar_pop(t, f).alias("c"))
    g = g.withColumn("range", F.when(F.col("range") > 0, F.col("range")).otherwise(1.0))
    c1, c2 = F.pow(0.01 * F.col("range"), 2), F.pow(0.03 * F.col("range"), 2)
    ssim = (2 * F.col("mt") * F.col("mf") + c1) * (2 * F.col("c") + c2) / ((F.col("mt") * F.col("mt") + F.col("mf") * F.col("mf") + c1) * (F.col("vt") + F.col("vf") + c2))
    psnr = 20 * F.log10(F.col("range") / (F.sqrt("mse") + 1e-8))
    return g.select(*keys, "n", "mse", F.sqrt("mse").alias("rmse"), psnr.alias("psnr"), ssim.alias("ssim"))


def sample_moments(samples: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean, variance, energy_density: one figure a channel and time from its samples."""
    return samples.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.avg(F.col("value") * F.col("value")).alias("energy_density"))


def sequence_summary(frames: DataFrame, *keys: str) -> DataFrame:
    """keys, n, first, last, missing: the frames that are there, and how many between them aren't."""
    return frames.groupBy(*keys).agg(F.countDistinct("frame").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")).withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("n"))
