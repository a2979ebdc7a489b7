"""Fourier and cosine coefficients of whole frames and back; errors by scale and coherence by band.

Only the transforms run a frame at a time, in grouped Arrow functions; what is said about bands is aggregation over their
coefficients. A frame that lacks a cell or a value is refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratascope.operators.dual_tree import _checked
from stratascope.operators.kernels import cosine_basis
from stratascope.operators.planes import wavenumber


def _plane(rows: pa.Table, y: str, x: str, value: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), value.dtype)
    out[rows[y].to_numpy(), rows[x].to_numpy()] = value
    return out


def _table(frame: int, names: tuple[str, str], planes: dict[str, np.ndarray]) -> pa.Table:
    shape = next(iter(planes.values())).shape
    y, x = np.indices(shape).reshape(2, -1).astype(np.int32)
    return pa.table([pa.array(np.full(y.size, frame, np.int64)), pa.array(y), pa.array(x), *[pa.array(np.ascontiguousarray(p, float).ravel()) for p in planes.values()]], names=["frame", *names, *planes])


def _typed(frames: DataFrame, names: tuple[str, str], *values: str) -> DataFrame:
    return frames.select(F.col("frame").cast("long"), *[F.col(n).cast("int") for n in names], *[F.col(v).cast("double") for v in values])


def fourier(frames: DataFrame, height: int, width: int, *values: str) -> DataFrame:
    """frame, ky, kx (places from 0, as the transform gives them), and re and im of each value column: unscaled coefficients."""
    values = values or ("value",)
    for v in values:
        _checked(frames.withColumn("value", F.col(v)), height, width)

    def kernel(rows: pa.Table) -> pa.Table:
        planes = {}
        for v in values:
            z = np.fft.fft2(_plane(rows, "y", "x", rows[v].to_numpy(), height, width))
            planes |= {f"{v}_re": z.real, f"{v}_im": z.imag}
        return _table(rows["frame"][0].as_py(), ("ky", "kx"), planes)

    return _typed(frames, ("y", "x"), *values).groupBy("frame").applyInArrow(kernel, "frame long, ky int, kx int, " + ", ".join(f"{v}_re double, {v}_im double" for v in values))


def inverse_fourier(coefficients: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """frame, y, x, value: the real part; coefficients that are left out count as zero."""

    def kernel(rows: pa.Table) -> pa.Table:
        z = _plane(rows, "ky", "kx", rows[f"{value}_re"].to_numpy() + 1j * rows[f"{value}_im"].to_numpy(), height, width)
        return _table(rows["frame"][0].as_py(), ("y", "x"), {"value": np.fft.ifft2(z).real})

    return _typed(coefficients, ("ky", "kx"), f"{value}_re", f"{value}_im").groupBy("frame").applyInArrow(kernel, "frame long, y int, x int, value double")


def cosine(frames: DataFrame, height: int, width: int) -> DataFrame:
    """frame, ky, kx, value: orthonormal cosine coefficients."""
    _checked(frames, height, width)
    cy, cx = cosine_basis(height), cosine_basis(width)

    def kernel(rows: pa.Table) -> pa.Table:
        return _table(rows["frame"][0].as_py(), ("ky", "kx"), {"value": cy @ _plane(rows, "y", "x", rows["value"].to_numpy(), height, width) @ cx.T})

    return _typed(frames, ("y", "x"), "value").groupBy("frame").applyInArrow(kernel, "frame long, ky int, kx int, value double")


def inverse_cosine(coefficients: DataFrame, height: int, width: int) -> DataFrame:
    """frame, y, x, value; coefficients that are left out count as zero."""
    cy, cx = cosine_basis(height), cosine_basis(width)

    def kernel(rows: pa.Table) -> pa.Table:
        return _table(rows["frame"][0].as_py(), ("y", "x"), {"value": cy.T @ _plane(rows, "ky", "kx", rows["value"].to_numpy(), height, width) @ cx})

    return _typed(coefficients, ("ky", "kx"), "value").groupBy("frame").applyInArrow(kernel, "frame long, y int, x int, value double")


def whole_number(i: Column, n: int) -> Column:
    """The signed whole wavenumber of a place: the first half as it is, the rest from below."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n)


def errors_by_scale(pairs: DataFrame, height: int, width: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """frame, low_rmse, mid_rmse, high_rmse, total_rmse of ``pairs`` (frame, y, x, truth, forecast).

    The error's coefficients within ``low`` whole wavenumbers, up to ``high``, and beyond; by default 0.15 and 0.4 of half
    the shorter side. The squares of the three add up to that of the total.
    """
    most = float(min(height, width) // 2)
    low, high = 0.15 * most if low is None else low, 0.4 * most if high is None else high
    c = fourier(pairs.select("frame", "y", "x", (F.col("forecast") - F.col("truth")).alias("error")), height, width, "error")
    ky, kx = whole_number(F.col("ky"), height).cast("double"), whole_number(F.col("kx"), width).cast("double")
    r = F.sqrt(ky * ky + kx * kx)
    band = {"low": r <= low, "mid": (r > low) & (r <= high), "high": r > high, "total": F.lit(True)}
    power = (F.col("error_re") * F.col("error_re") + F.col("error_im") * F.col("error_im")) / float(height * width) ** 2
    return c.groupBy("frame").agg(*[F.sqrt(F.sum(F.when(inside, power).otherwise(0.0))).alias(f"{name}_rmse") for name, inside in band.items()])


def coherence(pairs: DataFrame, height: int, width: int, dy: float = 1.0, dx: float = 1.0) -> DataFrame:
    """frame, band, n, k (mean radians per unit), coherence: |mean cross-spectrum| squared over both mean powers, by radial band.

    Bands are as many as half the shorter side (two at least) up to the lower of both axes' highest wavenumbers; the mean
    takes no part. Where one field has no power the coherence is 0. A band of one coefficient is coherent by construction.
    """
    c = fourier(pairs, height, width, "truth", "forecast")
    bands = max(min(height, width) // 2, 2)
    step = min(height // 2 / (height * dy), width // 2 / (width * dx)) / bands
    ky, kx = wavenumber(F.col("ky"), height, dy), wavenumber(F.col("kx"), width, dx)
    rows = c.withColumn("k", F.sqrt(ky * ky + kx * kx)).withColumn("band", F.floor(F.col("k") / step).cast("int")).where(f"k > 0 AND band < {bands}")
    t, f = (lambda p: F.col(f"truth_{p}")), (lambda p: F.col(f"forecast_{p}"))
    across = [F.sum(f("re") * t("re") + f("im") * t("im")), F.sum(f("im") * t("re") - f("re") * t("im"))]
    power = [F.sum(g("re") * g("re") + g("im") * g("im")) for g in (t, f)]
    g = rows.groupBy("frame", "band").agg(F.count("*").alias("n"), (2 * math.pi * F.avg("k")).alias("k"), (across[0] * across[0] + across[1] * across[1]).alias("c"), (power[0] * power[1]).alias("p"))
    return g.select("frame", "band", "n", "k", F.when(F.col("p") > 0, F.col("c") / F.col("p")).otherwise(0.0).alias("coherence"))
