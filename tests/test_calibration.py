"""Curves of excess, the simultaneous test, tails, cliques and pools against plain arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import calibration as cal
from stratascope.operators.testing import adjust

RADII = [0.05, 0.1, 0.3, 0.5, 0.9]


def members(spark, planted: float, seed=1, n=400, null=19):
    rng = np.random.default_rng(seed)
    own = [np.concatenate([rng.uniform(0, 0.04, int(planted * n)), rng.uniform(0.2, 1, n - int(planted * n))]), *[rng.uniform(0.2, 1, n) for _ in range(null)]]
    rows = [(k, float(d)) for k, v in enumerate(own) for d in v] + [(0, None)]
    return spark.createDataFrame(rows, "member int, distance double"), own


def test_curve_and_separation_equal_plain_ones(spark):
    for planted in (0.2, 0.0):
        df, own = members(spark, planted)
        f = np.array([[(v <= r).mean() for v in own] for r in RADII])
        fractions = cal.member_fractions(df, RADII)
        assert {(r["member"], r["radius"]): r["fraction"] for r in fractions.collect()} == pytest.approx({(k, r): f[i, k] for i, r in enumerate(RADII) for k in range(20)})
        curve = {r["radius"]: r for r in cal.excess_curve(fractions).collect()}
        for i, r in enumerate(RADII):
            assert curve[r]["excess"] == pytest.approx(f[i, 0] - f[i, 1:].mean()) and curve[r]["p_value"] == pytest.approx((1 + (f[i, 1:] >= f[i, 0]).sum()) / 20)
        others = (f[:, 1:].sum(1)[:, None] - f[:, 1:]) / 18
        null = (f[:, 1:] - others).max(0)
        statistic = (f[:, 0] - f[:, 1:].mean(1)).max()
        got = cal.separation(fractions).first()
        assert got["statistic"] == pytest.approx(statistic) and got["critical"] == pytest.approx(np.quantile(null, 0.95, method="higher"))
        assert got["p_value"] == pytest.approx((1 + (null >= statistic).sum()) / 20) and got["significant"] is (planted > 0) and got["members"] == 19 and got["swept"] > 19
        read = cal.recurrence(cal.excess_curve(fractions), got["critical"]).first()
        if planted:
            assert read["fraction"] == pytest.approx(0.2, abs=0.03) and read["read_at"] >= 2 and read["stable"]
        else:
            assert read["read_at"] <= 1 and not read["stable"]


def test_refusals(spark):
    df, _ = members(spark, 0.1)
    few = cal.member_fractions(df.where("member <= 1"), RADII)
    for refused in (lambda: cal.member_fractions(df, []), lambda: cal.separation(few), lambda: cal.separation(few, alpha=1.0), lambda: cal.recurrence(cal.excess_curve(few), float("nan")), lambda: cal.lower_tail(df.where("member = 0").limit(20)), lambda: cal.least_pool(0), lambda: cal.least_pool(3, corresponding=4), lambda: cal.expected_cliques(spark.createDataFrame([(1, 1, 1)], "scenes int, configurations int, edges int"))):
        with pytest.raises(Refused):
            refused()


@pytest.mark.parametrize("shape", [-0.3, 0.25])
def test_tail_is_the_most_likely_one(spark, shape):
    rng = np.random.default_rng(4)
    x = (rng.uniform(size=20_000) ** -shape - 1) / shape * 0.1  # a generalised Pareto distance below 1
    df = spark.createDataFrame([(float(1 - v),) for v in x], "distance double")
    tail = cal.lower_tail(df, percentile=20.0)
    below = tail.threshold - (1 - x)[(1 - x) < tail.threshold]

    def loss(k: float, s: float) -> float:
        z = 1 + k * below / s
        return math.inf if (z <= 0).any() else len(below) * math.log(s) + (1 + 1 / k) * np.log(z).sum()

    best = loss(tail.shape, tail.scale)
    assert all(loss(tail.shape + a, tail.scale * b) >= best - 1e-6 for a in (-0.01, 0, 0.01) for b in (0.98, 1, 1.02))
    assert tail.shape == pytest.approx(shape, abs=0.08) and tail.exceedances == len(below) and tail.rate == pytest.approx(0.2, abs=0.01)
    p = df.select(cal.tail_probability(F.lit(tail.threshold - 0.05), tail).alias("in"), cal.tail_probability(F.lit(tail.threshold + 1.0), tail).alias("out")).first()
    assert p["in"] == pytest.approx(tail.rate * (below >= 0.05).mean(), rel=0.1) and p["out"] == 1.0


def test_cliques_and_pools(spark):
    df = spark.createDataFrame([(6, 20, 121), (5, 1, 10)], "scenes int, configurations int, edges int")
    for r in cal.expected_cliques(df).collect():
        s, c, e, m = r["scenes"], r["configurations"], r["edges"], r["size"]
        p = e / (math.comb(s, 2) * c * c)
        assert r["sets"] == pytest.approx(math.comb(s, m) * c**m) and r["expected"] == pytest.approx(r["sets"] * p ** math.comb(m, 2))
        if m == 2:
            assert r["expected"] == pytest.approx(e)
    for method in ("bonferroni", "bh", "by"):
        for tests, real in ((6, 6), (6, 3), (6, 1)):
            least = cal.least_pool(tests, method=method, corresponding=real)
            for pool, found in ((least, True), (least - 1, False)):
                rows = [(str(i), 1 / (pool + 1) if i < real else 1.0) for i in range(tests)]
                q = adjust(spark.createDataFrame(rows, "test string, p_value double"), tests).agg(F.min(method)).first()[0]
                assert (q <= 0.05 + 1e-12) is found, (method, tests, real, pool)
    assert cal.least_pool(6) == 48
