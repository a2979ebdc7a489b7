"""Digests of many names at once, and perturbed sums made of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratascope.operators import hashes
from stratascope.operators import subspaces as sub


@pytest.mark.parametrize("tail", ["", ":3:r"])
def test_digests_equal_the_library(tail):
    names = ["", "a", "é", *[str(7 * i) + "-" * (i % 5) for i in range(50)], *["x" * n for n in (40, 50, 51, 52, 53, 54, 55, 56, 64, 200)]]
    heads = [f"7:{d}:" for d in (1, 9, 10, 99, 100)]
    got = [hashes.numbers(w) for w in hashes.digests(heads, pa.array(names), tail, at_once=17)]
    for head, own in zip(heads, got):
        assert own.tolist() == [int(hashlib.md5((head + n + tail).encode()).hexdigest()[:12], 16) for n in names]


def test_perturbed_sums_need_no_row_for_each_draw(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(str(i), i % 3, rng.normal(size=3).tolist()) for i in range(90)], "id string, region int, v array<double>")
    want, got = sub._by_draw(sub.perturbed(rows, 4, 0.1, 5), 2), sub._perturbed_by_draw(rows, 2, 4, 0.1, 5)
    assert want.keys() == got.keys() == set(range(5))
    for draw, parts in want.items():
        assert [p.n for p in parts] == [p.n for p in got[draw]] == [30] * 3
        for a, b in zip(parts, got[draw]):
            assert b.s == pytest.approx(a.s, abs=1e-9) and b.q == pytest.approx(a.q, abs=1e-9)
    assert rows.where(F.lit(False)).count() == 0 and sub._perturbed_by_draw(rows.where(F.lit(False)), 2, 4, 0.1, 5) == {}
