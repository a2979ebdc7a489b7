"""Operators against brute force on small made-up tables, and their refusals."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import clocks, events, governance, grids, intervals, kernels, neighbours, nulls, profiles, search, testing, verification
from stratascope.sources import catalogue, delimited
from stratascope.streaming import streams


def test_interval_algebra_is_set_algebra(spark):
    rnd = random.Random(3)
    rows = {side: [(k, a := rnd.randrange(60), a + rnd.randrange(0, 12)) for k in (1, 2) for _ in range(12)] for side in "lr"}
    left, right = (spark.createDataFrame(rows[s], "k long, start long, end long") for s in "lr")
    cells = lambda own, k: {t for q, a, b in own if q == k for t in range(a, b)}
    got = lambda df, k: [(r["start"], r["end"]) for r in df.where(F.col("k") == k).orderBy("start").collect()]
    spread = lambda pairs: {t for a, b in pairs for t in range(a, b)}
    both, less, joined, rest = intervals.intersect(left, right, 7, "k"), intervals.subtract(left, right, 7, "k"), intervals.merge(left, "k"), intervals.complement(left, 5, 70, "k")
    for k in (1, 2):
        a, b = cells(rows["l"], k), cells(rows["r"], k)
        assert spread(got(both, k)) == a & b and spread(got(less, k)) == a - b and spread(got(joined, k)) == a
        assert spread(got(rest, k)) == set(range(5, 70)) - a
        assert all(x[1] < y[0] for x, y in itertools.pairwise(got(joined, k)))


def test_unseen_windows_are_no_misses(spark):
    s = spark.createDataFrame([("a", 0), ("a", 3), ("a", 9), ("b", 4), ("b", 10)], "pattern string, frame long")
    grid = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 8, 9, 10)], "frame long")
    row = events.precursor_counts(s, grid, [(1, 2)]).where("antecedent = 'a' AND consequent = 'b'").first()
    # 0: seen, no b; 3: seen, b at 4; 9: the window leaves the grid
    assert (row["anchors"], row["eligible"], row["support"], row["confidence"]) == (3, 2, 1, 0.5)
    assert {r["frame"]: r["status"] for r in events.window_status(grid, [(1, 2)]).collect()}[5] == "INCOMPLETE"


def test_adjust_and_power(spark):
    p = [0.001, 0.01, 0.02, 0.5]
    got = testing.adjust(spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(p)], "test string, p_value double"), 10).orderBy("test").collect()
    assert [round(r["bonferroni"], 6) for r in got] == [0.01, 0.1, 0.2, 1.0]
    assert [round(r["holm"], 6) for r in got] == [0.01, 0.09, 0.16, 1.0]
    assert [round(r["bh"], 6) for r in got] == [0.01, 0.05, 0.066667, 1.0]
    assert testing.required_surrogates(10) == 199 and testing.check_power(199, 10) and not testing.check_power(198, 10)
    assert testing.detection_rank(10, 199) == 0 and testing.detection_rank(10, 99) < 0
    with pytest.raises(Refused):
        testing.checked_size(spark.range(5), 4)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 3), (3, 3), (4, 5), (5, 3)):
        cost = rng.uniform(size=(n, m))
        got = sum(cost[i, j] for i, j in kernels.assignment(cost))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum((cost[i, j] if n <= m else cost[j, i]) for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert got == pytest.approx(best)
    assert kernels.assignment(np.array([[np.inf, 1.0], [np.inf, np.inf]])) == [(0, 1)]


def test_tracks_follow_and_end(spark):
    rows = [("s", t, float(t), 0.0) for t in range(5)] + [("s", t, 20.0 - t, 5.0) for t in range(3)]
    got = kernels.tracks(spark.createDataFrame(rows, "series string, frame long, y double, x double"), 1.5).toPandas()
    assert sorted(got.groupby("track").size()) == [3, 5]


def test_wavelets_and_surrogates_keep_energy():
    v = np.random.default_rng(2).normal(size=64)
    parts = kernels.stationary_levels(v, 3, kernels.daubechies_two())
    assert sum((p * p).sum() / 2.0 ** min(j + 1, 3) for j, p in enumerate(parts)) == pytest.approx((v * v).sum())
    for s in (kernels.phase_randomised(v, 1), kernels.iterated_surrogate(v, 1)):
        assert (s * s).sum() == pytest.approx((v * v).sum())
    assert np.allclose(kernels.cosine_basis(8) @ kernels.cosine_basis(8).T, np.eye(8))


def test_haar_round_trip(spark):
    rng = np.random.default_rng(4)
    cells = [(y, x, float(rng.normal())) for y in range(6) for x in range(4)]
    back = grids.inverse_haar(grids.haar(spark.createDataFrame(cells, "y long, x long, value double"))).collect()
    assert {(r["y"], r["x"]): pytest.approx(r["value"]) for r in back} == {(y, x): v for y, x, v in cells}


def test_crps_and_ranks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 5)).round(1)
    df = spark.createDataFrame([(i, float(v), 0.1) for i in range(4) for v in x[i]], "case long, value double, truth double")
    got = {r["case"]: r["crps"] for r in verification.crps(df, "case").collect()}
    for i in range(4):
        want = np.abs(x[i] - 0.1).mean() - np.abs(x[i][:, None] - x[i][None]).mean() / 2
        assert got[i] == pytest.approx(want)
    assert sum(r["share"] for r in verification.rank_histogram(df, "case").collect()) == pytest.approx(4)


def test_profiles(spark):
    rows = [("p", 1, 10.0, 1.0), ("p", 2, 20.0, 3.0), ("q", 1, 10.0, 1.0), ("q", 2, 5.0, 2.0), ("r", 1, 10.0, None)]
    df = spark.createDataFrame(rows, "profile string, seq long, pressure double, value double")
    assert {r["profile"] for r in profiles.strict_profiles(df, 0, 100).collect()} == {"p", "r"}
    assert {r["profile"]: r["value"] for r in profiles.at_level(df, 15.0, 20.0, "profile").collect()} == {"p": 2.0}
    assert profiles.at_level(df, 15.0, 5.0, "profile").count() == 0
    bins = {(r["profile"], r["bin"]): r["mean"] for r in profiles.depth_bins(df, [0.0, 10.0, 20.0], "profile").collect()}
    assert bins["p", 1] == 2.0 and bins["r", 1] is None and bins["p", 0] is None


def test_chain_notices_a_change(spark):
    rows = [(1, i, f"text {i}") for i in range(4)] + [(2, 0, "other")]
    own = governance.chained(spark.createDataFrame(rows, "k long, seq long, text string"), ["text"], "k")
    ok = lambda df: {r["k"]: r["intact"] for r in governance.verified_chains(df, ["text"], "k").collect()}
    assert ok(own) == {1: True, 2: True}
    assert ok(own.withColumn("text", F.when((F.col("k") == 1) & (F.col("seq") == 2), "forged").otherwise(F.col("text")))) == {1: False, 2: True}


def test_refusals(spark):
    with pytest.raises(Refused):
        clocks.align_exact(spark.createDataFrame([(1, 1.0)], "time long, value double"), spark.createDataFrame([(2, 1.0)], "time long, value double"), least=24)
    with pytest.raises(Refused):
        neighbours.subsets(spark.createDataFrame([(1, i) for i in range(9)], "g long, member long"), 2, "g", most=8)
    with pytest.raises(Refused):
        governance.guard_unopened(spark.createDataFrame([("held",)], "partition string"), "held")
    with pytest.raises(Refused):
        governance.page(spark.range(3), 0, 0, F.col("id"))


def test_delimited(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("t,x,y\n1,2.5,\n2,3.5,1\n4,0,2\n")
    got = delimited.read_channels(spark, str(good), "t", ["x", "y"]).orderBy("channel", "time").collect()
    assert [(r["channel"], r["time"], r["value"]) for r in got] == [("x", 1, 2.5), ("x", 2, 3.5), ("x", 4, 0), ("y", 1, None), ("y", 2, 1), ("y", 4, 2)]
    (tmp_path / "b.csv").write_text("t,x\n1,2\n1,3\n")
    with pytest.raises(Refused):
        delimited.read_channels(spark, str(tmp_path / "b.csv"), "t", ["x"])
    (tmp_path / "c.csv").write_text("t,x\n1,2\n2,no\n")
    with pytest.raises(Refused):
        delimited.read_channels(spark, str(tmp_path / "c.csv"), "t", ["x"])
    delimited.export(spark.range(3), str(tmp_path / "out"), "json", {"from": "test"})
    assert spark.read.json(str(tmp_path / "out/data")).count() == 3 and "test" in spark.read.text(str(tmp_path / "out/provenance")).first()[0]


def test_sources_and_artifacts(spark, tmp_path):
    s = catalogue.Sources()
    s.register(catalogue.Source(1, "broken", lambda n: True, lambda sp, n: sp.read.parquet(str(tmp_path / "nothing"))))
    s.register(catalogue.Source(2, "made", lambda n: n == "cube", lambda sp, n: sp.range(2), simulated=True))
    df, attempts = s.resolve(spark, "cube")
    assert df.first()["source_name"] == "made" and [a[0] for a in attempts] == ["broken", "made"]
    with pytest.raises(Refused):
        s.resolve(spark, "else")
    store = catalogue.ArtifactStore(spark, str(tmp_path / "store"))
    name = store.put(spark.range(100).withColumn("v", F.col("id") * 2), "id")
    assert store.put(spark.range(100).withColumn("v", F.col("id") * 2), "id") == name and store.load(name, "id").count() == 100
    spark.dataSource.register(catalogue.SimulatedCube)
    cube = spark.read.format("simulated_cube").option("times", 3).option("rows", 2).option("columns", 4).load()
    assert cube.count() == 24


def test_streams(spark, tmp_path):
    rows = [(1, 10_000), (1, 10_500), (1, 15_000), (2, 10_100)]
    spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, t timestamp").parquet(str(tmp_path / "in"))
    got = streams.run_once(streams.merged_supports(stream, 900), str(tmp_path), "append").collect()
    assert (1, 10_000, 11_400) in {(r["user_id"], r["start"], r["end"]) for r in got}


def test_clusters_of_parts_and_of_whole_groups(spark):
    """Linking connected parts gives what linking whole groups gives, and no group is too large."""
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=2)]) for i in range(150)]
    got = {r["id"]: r["cluster"] for r in kernels.clusters(spark.createDataFrame(rows, "id long, group long, v array<double>"), "group", 0.5, most=60).collect()}
    want = {}
    for g in range(3):
        own = [(i, v) for i, k, v in rows if k == g]
        at = np.array([v for _, v in own])
        label = kernels.complete_linkage(np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)), 0.5)
        want |= {i: own[c][0] for (i, _), c in zip(own, label)}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in kernels.connected(chain).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_linkage_from_pairs_and_of_a_long_part(spark):
    """Pairs within the tolerance give what the whole matrix gives, ties included; a part of more than 5,000 vectors is linked."""
    rng = np.random.default_rng(8)
    for n, steps in ((60, 5), (80, 9), (40, 3)):
        at = rng.integers(0, steps, (n, 2)).astype(float)  # many equal distances
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
        a, b = np.nonzero(np.triu(d <= 2.0, 1))
        for tolerance in (1.0, 1.5, 2.0):
            assert kernels.sparse_linkage(b, a, d[a, b], n, tolerance).tolist() == kernels.complete_linkage(d, tolerance).tolist()
    chain = spark.range(5200).select("id", F.lit(1).alias("group"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    got = kernels.clusters(chain, "group", 1.2).toPandas()
    assert (got["cluster"] == got["id"] // 2 * 2).all() and len(got) == 5200


def test_surrogates_keep_what_they_must(spark):
    record = spark.createDataFrame([(c, f, float(f * (c == "a") + 1000 * (c == "b") - f)) for c in "ab" for f in range(0, 96) if f % 7], "channel string, frame long, value double")
    whole = {c: sorted(r["value"] for r in record.collect() if r["channel"] == c) for c in "ab"}
    for moved in (nulls.circular_clock_shift(record, 3, 10, 1), nulls.whole_cycle_clock_shift(record, 3, 12, 1), nulls.within_group_clock_shift(record, 3, F.floor(F.col("frame") / 24), 1)):
        rows = moved.collect()
        assert len(rows) == 3 * record.count()
        for draw in (1, 2, 3):
            for c in "ab":
                assert sorted(r["value"] for r in rows if r["draw"] == draw and r["channel"] == c) == whole[c]
    assert {r["frame"] for r in nulls.block_bootstrap(record, 1, 5, 1).collect()} == {r["frame"] for r in record.collect()}
    with pytest.raises(Refused):
        nulls.global_value_shuffle(record)


def test_axes_and_unions_refuse_what_is_too_much(spark):
    axis = spark.range(40).select(F.col("id").alias("x"))
    with pytest.raises(Refused):
        search.parameter_grid(axis, axis.withColumnRenamed("x", "y"))
    with pytest.raises(Refused):
        search.merged([axis, axis], "x")


def test_nearest_values_against_brute_force(spark):
    rng = np.random.default_rng(9)
    left, right = ([(int(i), int(rng.integers(2)), float(rng.integers(12))) for i in range(n)] for n in (40, 25))
    make = lambda rows: spark.createDataFrame(rows, "id long, k long, value double")
    got = {r["left"]: (r["right"], r["distance"], r["next"]) for r in neighbours.nearest_values(make(left), make(right), 1, "k").collect()}
    for i, k, v in left:
        near = sorted((abs(v - w), j) for j, q, w in right if q == k)
        assert got[i] == (near[0][1], near[0][0], near[1][0])


def test_features_near_poles_and_seam(spark):
    rng = np.random.default_rng(5)
    fixes, features = ([(int(i), float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(n)] for n in (80, 300))
    make = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {r["id"]: r["n"] for r in neighbours.features_within(make(fixes), make(features), 1500.0).collect()}
    for i, a, b in fixes:
        d = [6371 * 2 * np.arcsin(min(1, np.sqrt(np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(e - b) / 2) ** 2))) for _, c, e in features]
        assert got[i] == sum(x <= 1500 for x in d)


def test_constellations_of_a_large_order(spark, tmp_path):
    from stratascope.plans import record_queries

    spark.range(1, 21).select(F.lit(1).cast("long").alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r["members"] for r in record_queries.constellations(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted("+".join(map(str, c)) for c in itertools.combinations(range(1, 21), 3))


def test_blocks_of_neighbours_meet(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "id long, v array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be read by one task
    try:
        found = neighbours.similarities(rows, rows.where("id % 10 = 0"), "id", "v", 3, block=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 300, 10):
        order = [int(j) for j in np.argsort(-(unit @ unit[i])) if j != i][:3]
        assert [r["other"] for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])] == order


def test_crowded_places_are_compared_once(spark):
    """2,000 rows at each of two places 556 km apart, a lone fix, and one whose place is unknown."""
    spots = [(0.0, 0.0), (5.0, 0.0)]
    features = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(5.0).alias("lat"), F.lit(0.0).alias("lon"))
    fixes = spark.createDataFrame([(i, *spots[i % 2]) for i in range(2000)] + [(2000, 60.0, 10.0), (2001, None, 0.0)], "id long, lat double, lon double")
    out = neighbours.features_within(fixes, features, 900.0)
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got == {i: 4000 if i < 2000 else 0 for i in range(2002)}
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(_n" in joined  # places meet with the number of their rows


def _spans(seed, n, ids):
    rnd = random.Random(seed)
    return [(rnd.randrange(ids), a := rnd.randrange(-20, 60), a + rnd.randrange(0, 15), rnd.uniform(1, 9)) for _ in range(n)]


def test_overlaps_of_keys_in_blocks(spark):
    rows = _spans(4, 120, 23)
    out = intervals.pairwise_overlap(spark.createDataFrame(rows, "k long, start long, end long, v double").drop("v"), "k", 2.0, block=5)
    got = {(r["left"], r["right"]): (r["overlap"], r["effective"]) for r in out.collect()}
    cover = {k: {t for q, a, b, _ in rows if q == k for t in range(a, b)} for k in range(23)}
    assert got == {(i, j): (n, n / 2) for i in cover for j in cover if i < j and (n := len(cover[i] & cover[j]))}
    assert "_bucket" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for a pair and a stretch


def test_correlation_makes_no_pairs(spark):
    left, right = _spans(5, 90, 3), _spans(6, 70, 3)
    make = lambda rows: spark.createDataFrame(rows, "k long, start long, end long, value double")
    out = intervals.weighted_correlation(make(left), make(right), 7, "k")
    got = {r["k"]: r for r in out.collect()}
    for k in range(3):
        met = np.array([(min(b, e) - max(a, s), x, y) for q, a, b, x in left for r, s, e, y in right if q == r == k and b > a and e > s and a < e and s < b])
        w, x, y = met.T
        mean = lambda z: (w * z).sum() / w.sum()  # noqa: B023, E731
        r = (mean(x * y) - mean(x) * mean(y)) / np.sqrt((mean(x * x) - mean(x) ** 2) * (mean(y * y) - mean(y) ** 2))
        assert (got[k]["n_pairs"], got[k]["weight"]) == (len(met), w.sum()) and got[k]["r"] == pytest.approx(r)
    assert "a_start" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_over_parts(spark):
    from stratascope.operators import dependence

    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=500), np.repeat(0.25, 200), [np.inf, -np.inf]])
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "value double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9]
    assert dependence.quantiles(rows, "value", shares)[1:] == pytest.approx(np.quantile(v, shares[1:]).tolist())
    assert dependence.quantiles(rows.limit(0), "value", shares) is None
    coded = dependence.quantile_codes(rows.where("value IS NOT NULL"), 4)
    assert "percentile" not in coded._jdf.queryExecution().optimizedPlan().toString()  # whose buffer is the whole column, in one task
    edges = np.quantile(v, [0.25, 0.5, 0.75])
    assert sorted(r["code"] for r in coded.collect()) == sorted(int((edges <= x).sum()) for x in v)
