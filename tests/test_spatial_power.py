"""Spatial decorrelation, effective samples and attenuation against plain arrays, in parts and as a stream."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import spatial_power as sp


def smooth(rng, shape, width):
    """Noise averaged over a box: it decorrelates at about that width."""
    p = rng.normal(size=(shape[0] + width, shape[1] + width))
    return sum(p[i : i + shape[0], j : j + shape[1]] for i in range(width) for j in range(width)) / width**2


def plain_lengths(p):
    v, out = p - p.mean(), {}
    for name, axis in (("row", 0), ("column", 1)):
        moved = np.moveaxis(v, axis, 0)
        out[name] = None
        for lag in range(1, int(moved.shape[0] * 0.25) + 1):
            a, b = moved[:-lag], moved[lag:]
            floor = math.sqrt((a**2).sum() * (b**2).sum())
            if a.size < 4:
                break
            if floor <= 0:
                out[name] = 1
                break
            if abs((a * b).sum() / floor) < 1 / math.e:
                out[name] = lag
                break
    return out


def table(spark, planes):
    rows = [(k, y, x, float(v)) for k, p in enumerate(planes) for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "frame long, y int, x int, value double")


def test_lengths_and_samples_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:24, :40]
    planes = [smooth(rng, (24, 40), w) for w in (1, 3, 5)] + [np.full((24, 40), 7.0), x + 0.0, rng.normal(size=(24, 40)) + 5 * y, np.eye(24, 40)]
    states = sp.products(table(spark, planes), "frame")
    lengths = sp.decorrelation(states, "frame")
    got = {(r["frame"], r["axis"]): r["decorrelation"] for r in lengths.collect()}
    for k, p in enumerate(planes):
        assert {a: got[k, a] for a in ("row", "column")} == plain_lengths(p), k
    samples = {r["frame"]: r for r in sp.effective_samples(lengths, "frame").collect()}
    for k, p in enumerate(planes):
        own = plain_lengths(p)
        want = None if None in own.values() else 24 / own["row"] * 40 / own["column"]
        assert samples[k]["effective"] == (want and pytest.approx(want)) and samples[k]["adequate"] is (want is not None and want >= 2)


def test_states_of_parts_add_up(spark):
    """What the lines of a window say adds up, whatever part they are in."""
    f = table(spark, [smooth(np.random.default_rng(2), (16, 16), 3)])
    whole = {(r["axis"], r["lag"]): r["across"] for r in sp.products(f, "frame").collect()}
    parts = sp.products(f, "frame").withColumn("half", F.col("lag") % 2)
    again = sp.merged(parts.where("half = 0").unionByName(parts.where("half = 1")).drop("half"), "frame")
    assert {(r["axis"], r["lag"]): r["across"] for r in again.collect()} == pytest.approx(whole)


def stack(spark, rng, frames=120, side=16, lag=2):
    level = rng.integers(1, 6, frames)  # the target's size follows the source's, ``lag`` frames later
    source = [smooth(rng, (side, side), 2) * level[k] for k in range(frames)]
    target = [rng.normal(size=(side, side)) * (1 + 0.3 * level[k - lag]) for k in range(frames)]
    rows = [(c, k, y, x, float(v)) for c, own in (("source", source), ("target", target)) for k, p in enumerate(own) for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "channel string, frame long, y int, x int, value double"), source


def test_attenuation_grows_with_the_window_and_refuses_holes(spark):
    field, source = stack(spark, np.random.default_rng(3))
    curve = sp.attenuation(field, 16, 16, 120, 2, bins=3).orderBy("crop").collect()
    assert [r["crop"] for r in curve] == sp.crop_sizes(16) == [4, 6, 9, 11, 14, 16]
    assert curve[-1]["te"] > curve[0]["te"] >= 0
    own = [plain_lengths(source[k]) for k in sp.sampled_frames(120)]
    counts = [16 / o["row"] * 16 / o["column"] for o in own if None not in o.values()]
    assert curve[-1]["effective"] == (pytest.approx(np.median(counts)) if 2 * len(counts) > len(own) else None)
    for broken in (field.where("frame <> 7"), field.where("NOT (frame = 3 AND y = 8 AND x = 8)")):
        with pytest.raises(Refused, match="another measurement"):
            sp.attenuation(broken, 16, 16, 120, 2)
    with pytest.raises(Refused):
        sp.crop_sizes(3)


def test_energies_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    field, _ = stack(spark, np.random.default_rng(5), frames=12)
    timed = field.withColumn("t", F.timestamp_seconds(F.col("frame") * 60))
    timed.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")).withWatermark("t", "1 hour")
    sums = sp.crop_energies(stream, 16, 16, sp.crop_sizes(16), "channel", "t")
    run = sums.writeStream.format("memory").queryName("energies").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["channel"], int(r["t"].timestamp()) // 60, r["crop"]): r["energy"] for r in spark.table("energies").collect()}
    want = {(r["channel"], r["frame"], r["crop"]): r["energy"] for r in sp.crop_energies(field, 16, 16, sp.crop_sizes(16), "channel", "frame").collect()}
    assert got == pytest.approx(want) and len(want) == 2 * 12 * 6
