"""Spans from sums: against plain arrays, planted and null, and what is refused."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import subspaces as sub

NAMES = ("a", "b", "c")
RECIPE = sub.Recipe(dimensions=(1,), ridges=(0.1, 1.0), draws=99, perturbations=3, stable=0.2)


def data(spark, n=400, seed=1, planted=True, turn=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 2, 3] + [0, 5, -1]
    z = rng.normal(size=n)
    y = (0.8 * x[:, 0] + 0.5 * (x[:, 1] - 5) + turn * z * x[:, 2] if planted else 0) + rng.normal(size=n)
    rows = [(i, *map(float, r), float(v), float(w)) for i, (r, v, w) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double"), x, y, z


def number(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def test_moments_of_draws_equal_plain_ones(spark):
    df, x, y, z = data(spark, n=120)
    s = sub.scores_of(df, NAMES, "y", "z")
    v = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)])
    cuts = np.quantile(z, [1 / 3, 2 / 3])
    region = np.digitize(z, cuts, right=True)
    assert s.cuts == pytest.approx(cuts) and s.mean == pytest.approx(x.mean(0))
    own = sub.scored(df, s, F.col("id"))
    for made, change in ((sub.signed(own, 2, 5), lambda w, draw: np.column_stack([w[:, :3], w[:, 3] * [1 - 2 * (number(5, draw, i) % 2) for i in range(120)]])), (sub.perturbed(own, 1, 0.1, 5), lambda w, draw: w + (draw > 0) * 0.1 * np.array([[math.sqrt(-2 * math.log((number(5, draw, i, k, "r") + 1) / ((1 << 48) + 1))) * math.cos(2 * math.pi * (number(5, draw, i, k, "t") + 1) / ((1 << 48) + 1)) for k in range(4)] for i in range(120)]))):
        for row in sub.moments(made, 3, "draw", "region").collect():
            w = change(v, row["draw"])[region == row["region"]]
            assert row["n"] == len(w) and row["sums"] == pytest.approx(w.sum(0), abs=1e-9)
            assert row["products"] == pytest.approx([(w[:, i] * w[:, j]).sum() for i, j in combinations_with_replacement(range(4), 2)], abs=1e-9)


def test_explained_share_equals_a_regression(spark):
    df, x, y, _ = data(spark)
    s = sub.scores_of(df, NAMES, "y")
    (row,) = sub.moments(sub.scored(df, s, F.col("id")), 3, "region").collect()
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 2)))[0]
    v = (x - x.mean(0)) / x.std(0, ddof=1)
    design = np.column_stack([np.ones(len(y)), v @ basis])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert sub.Sums.of(row).explained(basis) == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum())


def test_power_iteration_finds_the_leading_span():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5, 5))
    m = m @ m.T
    want = np.linalg.eigh(m)[1][:, -2:]
    assert sub.projector_distance(sub.fitted(m, 2, sub.Recipe(iterations=400), 0), want) < 1e-6
    a, b = np.eye(4)[:, :2], np.eye(4)[:, 2:]
    assert sub.projector_distance(a, a @ rng.normal(size=(2, 2))) == pytest.approx(0, abs=1e-7) and sub.projector_distance(a, b) == pytest.approx(1)
    with pytest.raises(Refused):
        sub.projector_distance(a, b[:, :1])


def test_a_planted_span_is_replicated_and_noise_is_not(spark):
    for planted in (True, False):
        df, *_ = data(spark, n=600, seed=7, planted=planted)
        half, other = df.where("id % 2 = 0"), df.where("id % 2 = 1")
        s = sub.scores_of(half, NAMES, "y", "z")
        spans = sub.generated(half, s, F.col("id"), RECIPE)
        again = sub.confirmed(other, spans, s, F.col("id"), RECIPE).collect()
        assert len(again) == 2 and all(r["replicated"] is planted for r in again)
        if planted:
            direction = np.array(spans.orderBy("label").first()["basis"])[:, 0]
            assert abs(direction[2]) < 0.2 and all(r["explained"] > 0.4 and r["q"] < 0.05 for r in again)
            outside, *_ = data(spark, n=300, seed=99)  # another source: the same spans, unchanged
            assert all(r["replicated"] for r in sub.confirmed(outside, spans, s, F.col("id"), RECIPE).collect())


def test_a_relation_that_turns_with_the_nuisance_is_no_candidate(spark):
    df, *_ = data(spark, n=900, seed=5, turn=3.0)
    s = sub.scores_of(df, ("c", "a"), "y", "z")
    spans = sub.generated(df, s, F.col("id"), RECIPE).collect()
    assert all(r["region_range"] >= 0 for r in spans) and not any(r["candidate"] and r["region_range"] > RECIPE.regional for r in spans)


def test_refusals(spark):
    df, *_ = data(spark)
    s = sub.scores_of(df, NAMES, "y", "z")
    spans = sub.generated(df, s, F.col("id"), RECIPE)
    moved = spans.withColumn("basis", F.expr("transform(basis, (r, i) -> transform(r, x -> IF(i = 2, x + 1, x)))"))
    from dataclasses import replace

    for refused in (
        lambda: sub.scores_of(df.where("id < 50"), NAMES, "y"),
        lambda: sub.scores_of(df, ("a",), "y"),
        lambda: sub.scores_of(df.withColumn("a", F.lit(1.0)), NAMES, "y"),
        lambda: sub.scores_of(df.withColumn("a", F.when(F.col("id") > 0, F.col("a"))), NAMES, "y"),
        lambda: sub.generated(df, s, F.col("id"), replace(RECIPE, dimensions=(3,))),
        lambda: sub.generated(df, s, F.col("id"), replace(RECIPE, draws=19)),
        lambda: sub.confirmed(df, spans.limit(1), s, F.col("id"), RECIPE),
        lambda: sub.confirmed(df, moved, s, F.col("id"), RECIPE),
        lambda: sub.confirmed(df.where("id < 20"), spans, s, F.col("id"), RECIPE),
    ):
        with pytest.raises(Refused):
            refused()

def test_signed_sums_need_no_row_a_draw(spark):
    rows = spark.createDataFrame([(str(i), i % 3, [0.1 * i, -0.2 * i + 3, float(i % 7)]) for i in range(60)], "id string, region int, v array<double>")
    want, got = sub._by_draw(sub.signed(rows, 9, 5), 2), sub._signed_by_draw(rows, 2, 9, 5)
    assert want.keys() == got.keys()
    for draw, parts in want.items():
        for a, b in zip(parts, got[draw], strict=True):
            assert a.n == b.n and np.allclose(a.s, b.s) and np.allclose(a.q, b.q)
