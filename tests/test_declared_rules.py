"""Rules with declared constants and refusals: candidates not told apart, tolerance bounds, likeness, relations, nulls."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import discovery, nulls, planes, search


def test_candidates_within_a_standard_error_of_the_best(spark):
    rows = [("a", "b", 1, 0.80, 50.0), ("a", "b", 2, 0.79, 50.0), ("b", "a", 1, 0.74, 9.0), ("c", "a", 3, 0.60, 400.0), ("a", "c", 1, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "driver string, driven string, lag int, strength double, n double")
    best = search.best_of_pairs(df, "strength", ["lag"], "driver", "driven")
    assert {(r["driver"], r["driven"], r["lag"]) for r in best.collect()} == {("a", "b", 1), ("b", "a", 1), ("c", "a", 3), ("a", "c", 1)}
    near = lambda d: {(r["driver"], r["driven"]) for r in search.indistinguishable(d, "strength", "n").collect()}
    error = 1 / math.sqrt(50 - 3)
    own = best.where("strength < 1")
    assert near(own) == {(r[0], r[1]) for r in rows if r[3] < 1 and r[2] != 2 and math.atanh(0.8) - math.atanh(r[3]) <= error} == {("a", "b")}
    assert near(own.where("strength < 0.8")) == {("b", "a"), ("c", "a")}  # the best has nine effective pairs
    assert near(best) == {("a", "c")}  # a strength of one counts as 0.999999, three effective pairs as four


@pytest.mark.parametrize(("n", "coverage", "confidence"), [(10, 0.8, 0.9), (40, 0.8, 0.9), (60, 0.9, 0.95)])
def test_tolerance_bounds_are_order_statistics_of_positive_distances(spark, n, coverage, confidence):
    rng = np.random.default_rng(n)
    values = sorted(rng.integers(1, 12, n) / 4)  # many alike
    rows = [("k", float(v)) for v in rng.permutation([*values, 0.0, 0.0, -1.0])] + [("k", None)]
    got = discovery.tolerance_bounds(spark.createDataFrame(rows, "key string, distance double"), coverage, confidence, "key").first()
    below = lambda k: sum(math.comb(n, i) * coverage**i * (1 - coverage) ** (n - i) for i in range(k))
    rank = next((k for k in range(1, n + 1) if below(k) >= confidence), None)
    assert got["n"] == n and got["quantile"] == values[math.ceil(round(coverage * n, 9)) - 1] and got["bound"] == (None if rank is None else values[rank - 1])


def test_likeness_takes_sample_variances_and_a_range_of_one(spark):
    rng = np.random.default_rng(1)
    t, f = rng.normal(size=30), rng.normal(size=30)

    def plain(t, f):
        size = t.max() - t.min() or 1.0
        c1, c2 = (0.01 * size) ** 2, (0.03 * size) ** 2
        mse = ((t - f) ** 2).mean()
        ssim = (2 * t.mean() * f.mean() + c1) * (2 * ((t - t.mean()) * (f - f.mean())).mean() + c2) / ((t.mean() ** 2 + f.mean() ** 2 + c1) * (t.var(ddof=1) + f.var(ddof=1) + c2))
        return [mse, math.sqrt(mse), 20 * math.log10(size / (math.sqrt(mse) + 1e-8)), ssim]

    rows = [(k, float(a), float(b)) for k, (x, y) in enumerate([(t, f), (np.full(30, 2.0), f), (t, t)]) for a, b in zip(x, y)] + [(0, None, 1.0)]
    got = {r["key"]: r for r in planes.likeness(spark.createDataFrame(rows, "key int, truth double, forecast double"), "key").collect()}
    for k, (x, y) in enumerate([(t, f), (np.full(30, 2.0), f), (t, t)]):
        assert [got[k][c] for c in ("mse", "rmse", "psnr", "ssim")] == pytest.approx(plain(x, y)) and got[k]["n"] == 30


def test_relations_of_two_features(spark):
    feature = "struct<y:double,x:double,scale:double,extent:double,time:double,duration:double,angle:double>"
    one = lambda y, x, scale, extent, angle: (float(y), float(x), float(scale), float(extent), 10.0, 4.0, float(angle))
    rows = [(1, one(0, 0, 8, 20, 0), one(3, 4, 2, 5, 180)), (2, one(0, 0, 1, 1, 90), one(0, 5, 1, 1, 270)), (3, one(1, 1, 1, 1, 0), one(1, 1, 1, 1, 0))]
    df = spark.createDataFrame(rows, f"id int, a {feature}, b {feature}")
    got = {r["id"]: r for r in discovery.relations(df, 360.0, directed=True).collect()}
    bearing = math.degrees(math.atan2(4, 3))  # columns over rows
    assert got[1]["relative_scale"] == 4 and got[1]["distance"] == pytest.approx(5 / 4) and got[1]["direction"] == pytest.approx(bearing)
    assert got[1]["containment"] == pytest.approx((20 - (5 + 5)) / 20) and got[1]["contained"] and got[1]["convergence"] == pytest.approx(2 * math.cos(math.radians(bearing)))
    assert got[2]["convergence"] == pytest.approx(2) and got[2]["converging"] and not got[2]["contained"]
    assert got[3]["direction"] is None and got[3]["convergence"] is None and got[3]["distance"] == 0
    assert "convergence" not in discovery.relations(df, 180.0).columns  # an axis doesn't point


def test_nulls_refuse_what_would_be_no_null(spark):
    record = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "channel string, frame long, value double")
    short = record.where("frame < 1")
    for refused in (
        lambda: nulls.whole_cycle_clock_shift(record, 2, 20, 1),
        lambda: nulls.whole_cycle_clock_shift(record, 2, 0, 1),
        lambda: nulls.within_group_clock_shift(record, 2, F.lit(0), 1),
        lambda: nulls.block_bootstrap(record, 2, 20, 1),
        lambda: nulls.circular_clock_shift(record, 2, 11, 1),
        lambda: nulls.circular_clock_shift(short, 2, 0, 1),
    ):
        with pytest.raises(Refused):
            refused()
    assert nulls.whole_cycle_clock_shift(record, 2, 10, 1).where("value = frame").count() == 0
    assert nulls.block_bootstrap(record, 2, 19, 1).count() == 40


def test_a_query_name_stands_once():
    from stratascope.plans import catalogue
    from stratascope.plans.registry import Registry

    r = Registry()
    r.add("one")(lambda spark, d: None)
    with pytest.raises(ValueError, match="twice"):
        r.add("one")(lambda spark, d: None)
    with pytest.raises(ValueError, match="twice"):
        catalogue._joined([{"a": 1}, {"a": 2}])


def test_cosines_that_cancel_are_those_of_the_sql(spark):
    """Lines of sf0.1 whose bearings cancel to 0 or to the last bit."""
    import duckdb

    from stratascope.plans import discovery_queries as q

    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_orderkey IN (4993, 9509, 27717, 29509)")
    with tempfile.TemporaryDirectory() as folder:
        rows.write.parquet(f"{folder}/lineitem.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        want = sorted(db.execute(f"SELECT orderkey, line, part, next_part, converging FROM ({q.queries.sql['feature_relations']})").fetchall())
        got = q.feature_relations(spark, folder).select("orderkey", "line", "part", "next_part", "converging").collect()
    assert sorted(map(tuple, got)) == want


def test_support_keeps_no_scenes(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (None, "a"), (None, "b")], "scene long, member string")
    found = discovery.mined_motifs(discovery.motif_occurrences(members, 2, 9), 2)
    assert [tuple(r) for r in found.collect()] == [("a+b", 2)]
    assert "distinct" not in found._jdf.queryExecution().analyzed().toString().replace("Distinct", "").lower()
