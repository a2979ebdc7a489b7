"""Dual-tree complex wavelets of whole frames: two filter trees an axis, six oriented complex bands a level, and back.

A frame (frame, y, x, value) is transformed in one grouped Arrow function; frames are independent. Each axis is filtered by
two trees of orthonormal filters on a periodic grid. The first level's filters of tree b are those of tree a one sample
later; from the second level on tree b's are tree a's reversed, a quarter of a sample either way, so that the two trees
together see a signal and, nearly, its Hilbert transform. Sums and differences of the four combinations of trees are the
complex bands; they turn with a feature's direction and keep their size when it moves. Coefficients are halved, so that
their energies add up to the frame's.

Frames are extended to a multiple of 2 ** levels by repeating their last row and column, and the inverse cuts them back.
A missing cell or a null value makes a frame unusable: it is refused, and never filled in.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratascope.errors import Refused

# fixed values: published low-pass filters of tree a, a first level of ten taps and a quarter-shift filter of ten taps
FIRST = (0, -0.08838834764832, 0.08838834764832, 0.69587998903400, 0.69587998903400, 0.08838834764832, -0.08838834764832, 0.01122679215254, 0.01122679215254, 0)
QUARTER = (0.03516384, 0, -0.08832942, 0.23389032, 0.76027237, 0.58751830, 0, -0.11430184, 0, 0)
TREES, COARSE = ("a", "b"), 6
COEFFICIENTS = "frame long, level int, band int, y int, x int, re double, im double"


@cache
def polished(taps: tuple) -> np.ndarray:
    """The nearest taps that are orthonormal to rounding: Gauss-Newton on the products with even shifts and the sum, zeros kept."""
    h, free = np.array(taps, float), np.flatnonzero(taps)
    for _ in range(20):
        rows, gaps = [np.eye(len(h)).sum(0)], [math.sqrt(2) - h.sum()]
        for m in range(len(h) // 2):
            shifted = np.zeros((2, len(h)))
            shifted[0, : len(h) - 2 * m], shifted[1, 2 * m :] = h[2 * m :], h[: len(h) - 2 * m]
            rows.append(shifted.sum(0))
            gaps.append((m == 0) - h @ shifted[0])
        h[free] += np.linalg.lstsq(np.array(rows)[:, free], np.array(gaps), rcond=None)[0]
    return h


def filters(level: int, tree: str) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass and high-pass taps of a tree's axis."""
    if level == 1:
        low = polished(FIRST) if tree == "a" else np.roll(polished(FIRST), 1)
    else:
        low = polished(QUARTER) if tree == "a" else polished(QUARTER)[::-1]
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def _split(plane: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    n = plane.shape[axis]
    return sum(h * np.take(plane, (2 * np.arange(n // 2) + k) % n, axis) for k, h in enumerate(taps) if h)


def _joined(low: np.ndarray, high: np.ndarray, pair: tuple[np.ndarray, np.ndarray], axis: int) -> np.ndarray:
    """The transpose of both splits, added up."""
    half = low.shape[axis]
    out = np.moveaxis(np.zeros([2 * s if i == axis else s for i, s in enumerate(low.shape)]), axis, 0)
    for part, taps in zip((low, high), pair):
        part = np.moveaxis(part, axis, 0)
        for k, h in enumerate(taps):
            if h:
                out[(2 * np.arange(half) + k) % (2 * half)] += h * part  # a tap meets each place once
    return np.moveaxis(out, 0, axis)


def transform(plane: np.ndarray, levels: int) -> tuple[list[np.ndarray], dict]:
    """Six complex bands a level, as arrays (band, y, x), and the four low-pass planes by their trees."""
    low, bands = {(i, j): plane / 2 for i in TREES for j in TREES}, []
    for level in range(1, levels + 1):
        parts: dict = {}
        for (i, j), own in low.items():
            for ky, along_y in zip("lh", filters(level, i)):
                once = _split(own, along_y, 0)
                for kx, along_x in zip("lh", filters(level, j)):
                    parts[ky + kx, i, j] = _split(once, along_x, 1)
        low = {(i, j): parts["ll", i, j] for i in TREES for j in TREES}
        of = lambda kind: [parts[kind, i, j] for i in TREES for j in TREES]  # noqa: B023, E731
        bands.append(np.array([z for kind in ("lh", "hh", "hl") for z in _oriented(*of(kind))]))
    return bands, low


def _oriented(aa, ab, ba, bb) -> tuple[np.ndarray, np.ndarray]:
    s = math.sqrt(0.5)
    return s * (aa - bb) + 1j * s * (ab + ba), s * (aa + bb) + 1j * s * (ab - ba)


def _trees(p: np.ndarray, q: np.ndarray) -> dict:
    s = math.sqrt(0.5)
    return {("a", "a"): s * (p.real + q.real), ("a", "b"): s * (p.imag + q.imag), ("b", "a"): s * (p.imag - q.imag), ("b", "b"): s * (q.real - p.real)}


def inverse(bands: list[np.ndarray], low: dict) -> np.ndarray:
    for level in range(len(bands), 0, -1):
        b = bands[level - 1]
        lh, hh, hl = (_trees(b[2 * k], b[2 * k + 1]) for k in range(3))
        low = {t: _joined(_joined(low[t], lh[t], filters(level, t[1]), 1), _joined(hl[t], hh[t], filters(level, t[1]), 1), filters(level, t[0]), 0) for t in low}
    return sum(low.values()) / 2


def extended(plane: np.ndarray, levels: int) -> np.ndarray:
    step = 2**levels
    return np.pad(plane, [(0, -n % step) for n in plane.shape], mode="edge")


def _rows(bands: list[np.ndarray], low: dict) -> list[tuple[int, int, np.ndarray]]:
    """level, band, plane; the four low-pass planes stand at the last level, as the bands from COARSE on."""
    coarse = [(len(bands), COARSE + k, low[t].astype(complex)) for k, t in enumerate(sorted(low))]
    return [(level, k, z) for level, own in enumerate(bands, 1) for k, z in enumerate(own)] + coarse


def _checked(frames: DataFrame, height: int, width: int) -> None:
    whole = (F.count("value") == height * width) & (F.count("*") == height * width) & (F.countDistinct("y", "x") == height * width)
    if bad := frames.groupBy("frame").agg(whole.alias("whole")).where("NOT whole").select("frame").limit(1).collect():
        raise Refused(f"frame {bad[0][0]} lacks cells: a transform of what is there would be one of another field")


def dual_tree(frames: DataFrame, height: int, width: int, levels: int) -> DataFrame:
    """frame, level, band (0 to 5, and from 6 on the last level's low-pass planes), y, x, re, im of every frame."""
    if levels < 1 or min(height, width) < 2**levels:
        raise Refused(f"{levels} levels need {2**levels} cells along each axis")
    _checked(frames, height, width)

    def kernel(rows: pa.Table) -> pa.Table:
        plane = np.empty((height, width))
        plane[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["value"].to_numpy()
        frame, out = rows["frame"][0].as_py(), []
        for level, band, z in _rows(*transform(extended(plane, levels), levels)):
            y, x = np.indices(z.shape).reshape(2, -1).astype(np.int32)
            whole = lambda v, kind=np.int32, n=z.size: pa.array(np.full(n, v, kind))
            out.append(pa.table([whole(frame, np.int64), whole(level), whole(band), pa.array(y), pa.array(x), pa.array(z.real.ravel()), pa.array(z.imag.ravel())], names=[c.split()[0] for c in COEFFICIENTS.split(", ")]))
        return pa.concat_tables(out)

    return frames.select(F.col("frame").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double")).groupBy("frame").applyInArrow(kernel, COEFFICIENTS)


def _planes(height: int, width: int, levels: int) -> Callable[[pa.Table], tuple[list[np.ndarray], dict]]:
    full = [n + -n % 2**levels for n in (height, width)]

    def planes(rows: pa.Table) -> tuple[list[np.ndarray], dict]:
        column = lambda c: rows[c].to_numpy()
        level, band, y, x, z = column("level"), column("band"), column("y"), column("x"), column("re") + 1j * column("im")
        bands, low = [], {}
        for k in range(1, levels + 1):
            own = np.zeros((COARSE + 4, full[0] >> k, full[1] >> k), complex)
            here = level == k
            own[band[here], y[here], x[here]] = z[here]
            bands.append(own[:COARSE])
            if k == levels:
                low = {t: own[COARSE + i].real for i, t in enumerate((i, j) for i in TREES for j in TREES)}
        return bands, low

    return planes


def inverse_dual_tree(coefficients: DataFrame, height: int, width: int, levels: int) -> DataFrame:
    """frame, y, x, value: the frames that these coefficients are of; coefficients that are left out count as zero."""
    planes = _planes(height, width, levels)

    def kernel(rows: pa.Table) -> pa.Table:
        plane = inverse(*planes(rows))[:height, :width]
        y, x = np.indices(plane.shape).reshape(2, -1).astype(np.int32)
        return pa.table([pa.array(np.full(plane.size, rows["frame"][0].as_py(), np.int64)), pa.array(y), pa.array(x), pa.array(plane.ravel())], names=["frame", "y", "x", "value"])

    return coefficients.groupBy("frame").applyInArrow(kernel, "frame long, y int, x int, value double")


def band_energies(coefficients: DataFrame) -> DataFrame:
    """frame, level, band (null for the low-pass planes), energy, and its fraction of the frame's."""
    band = F.when(F.col("band") < COARSE, F.col("band")).alias("band")
    g = coefficients.groupBy("frame", "level", band).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))
    total = coefficients.groupBy("frame").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("total"))
    return g.join(total, "frame").select("frame", "level", "band", "energy", F.when(F.col("total") > 0, F.col("energy") / F.col("total")).alias("fraction"))
