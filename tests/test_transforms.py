"""Dual-tree wavelets, Fourier and cosine coefficients: round trips, energies, directions, refusals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import dual_tree, spectra


def frame(spark, planes):
    rows = [(k, y, x, float(v)) for k, p in enumerate(planes) for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "frame long, y int, x int, value double")


def plane_of(rows, shape, value="value"):
    out = np.zeros(shape)
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


def test_taps_are_orthonormal():
    for taps in (dual_tree.FIRST, dual_tree.QUARTER):
        h = dual_tree.polished(taps)
        assert np.abs(h - taps).max() < 1e-7 and all(abs(h[2 * m :] @ h[: len(h) - 2 * m] - (m == 0)) < 1e-14 for m in range(5))
        assert {i for i, x in enumerate(h) if x} == {i for i, x in enumerate(taps) if x}


@pytest.mark.parametrize("shape", [(32, 48), (37, 50), (8, 9)])
def test_dual_tree_round_trip_and_energy(spark, shape):
    rng = np.random.default_rng(1)
    planes = [rng.normal(size=shape), np.full(shape, 3.0), np.eye(*shape)]
    c = dual_tree.dual_tree(frame(spark, planes), *shape, 3)
    back = dual_tree.inverse_dual_tree(c, *shape, 3).collect()
    energies = dual_tree.band_energies(c).groupBy("frame").agg(F.sum("energy").alias("e"), F.sum("fraction").alias("f")).collect()
    for k, p in enumerate(planes):
        assert np.abs(plane_of([r for r in back if r["frame"] == k], shape) - p).max() < 1e-12
        (e,) = [r for r in energies if r["frame"] == k]
        assert e["e"] == pytest.approx((dual_tree.extended(p, 3) ** 2).sum(), rel=1e-12) and e["f"] == pytest.approx(1)


def test_bands_tell_directions():
    n, best = 64, []
    y, x = np.mgrid[:n, :n]
    for band in range(6):
        energy = [(np.abs(dual_tree.transform(np.cos(2 * np.pi * 0.18 * (np.cos(np.radians(t)) * x + np.sin(np.radians(t)) * y)), 3)[0][1][band]) ** 2).sum() for t in range(0, 180, 3)]
        best.append(3 * int(np.argmax(energy)))
    assert sorted(best) == pytest.approx([15, 45, 75, 105, 135, 165], abs=10)


def test_size_of_coefficients_hardly_moves_with_the_field():
    y, x = np.mgrid[:64, :64]
    bump = [np.exp(-((x - 28 - s) ** 2 + (y - 30) ** 2) / 18.0) for s in range(8)]
    complex_, real = [], []
    for p in bump:
        band = dual_tree.transform(p, 3)[0][1]
        complex_.append((np.abs(band) ** 2).sum())
        real.append((dual_tree._trees(band[0], band[1])["a", "a"] ** 2).sum())  # one tree alone, as in a plain wavelet transform
    spread = lambda v: np.std(v) / np.mean(v)
    assert spread(complex_) < 0.25 * spread(real)


def test_transforms_refuse_holes(spark):
    whole = frame(spark, [np.ones((8, 8))])
    for broken in (whole.where("y + x > 0"), whole.withColumn("value", F.when(F.col("y") > 0, F.col("value"))), whole.unionByName(whole.limit(1))):
        for run in (lambda f: dual_tree.dual_tree(f, 8, 8, 2), lambda f: spectra.fourier(f, 8, 8), lambda f: spectra.cosine(f, 8, 8)):
            with pytest.raises(Refused, match="lacks cells"):
                run(broken)
    with pytest.raises(Refused, match="levels"):
        dual_tree.dual_tree(whole, 8, 8, 4)


def test_fourier_and_cosine_round_trips(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(9, 12))
    f = frame(spark, [p])
    c = spectra.fourier(f, 9, 12)
    z = np.fft.fft2(p)
    got = {(r["ky"], r["kx"]): complex(r["value_re"], r["value_im"]) for r in c.collect()}
    assert max(abs(got[k] - z[k]) for k in got) < 1e-10 and len(got) == z.size
    assert np.abs(plane_of(spectra.inverse_fourier(c, 9, 12).collect(), (9, 12)) - p).max() < 1e-12
    assert np.abs(plane_of(spectra.inverse_cosine(spectra.cosine(f, 9, 12), 9, 12).collect(), (9, 12)) - p).max() < 1e-12
    low = spectra.inverse_fourier(c.where("ky = 0 AND kx = 0"), 9, 12).collect()
    assert all(r["value"] == pytest.approx(p.mean()) for r in low)


def pairs(spark, truth, forecast):
    rows = [(0, y, x, float(truth[y, x]), float(forecast[y, x])) for y, x in np.ndindex(*truth.shape)]
    return spark.createDataFrame(rows, "frame long, y int, x int, truth double, forecast double")


def test_errors_by_scale_add_up_and_find_their_band(spark):
    rng = np.random.default_rng(3)
    truth = rng.normal(size=(24, 32))
    r = spectra.errors_by_scale(pairs(spark, truth, truth + rng.normal(size=truth.shape)), 24, 32).first()
    assert r["low_rmse"] ** 2 + r["mid_rmse"] ** 2 + r["high_rmse"] ** 2 == pytest.approx(r["total_rmse"] ** 2)
    y, x = np.mgrid[:24, :32]
    for wave, band in ((1, "low"), (3, "mid"), (9, "high")):
        r = spectra.errors_by_scale(pairs(spark, truth, truth + np.cos(2 * np.pi * wave * x / 32)), 24, 32).first()
        assert r[f"{band}_rmse"] == pytest.approx(r["total_rmse"]) == pytest.approx(np.sqrt(0.5))


def test_coherence_of_a_field_with_itself_is_one(spark):
    rng = np.random.default_rng(4)
    truth = rng.normal(size=(24, 32))
    same = spectra.coherence(pairs(spark, truth, 2 * truth + 5), 24, 32).collect()
    assert all(r["coherence"] == pytest.approx(1) for r in same) and len(same) == 12
    other = spectra.coherence(pairs(spark, truth, rng.normal(size=truth.shape)), 24, 32).where("n > 20").collect()
    assert np.mean([r["coherence"] for r in other]) < 0.2
    assert {r["coherence"] for r in spectra.coherence(pairs(spark, truth, np.zeros((24, 32))), 24, 32).collect()} == {0.0}
