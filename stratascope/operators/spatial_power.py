"""How many independent structures a window of a field holds, and how a dependence fades as less of it is averaged.

Fields are long tables (keys, frame, y, x, value) of whole windows. Correlations along an axis come from lines: a window's
rows or columns as arrays, from which each lag's products are summed up without another shuffle. Sums of products and
energies add up over any split of the cells, so that a batch, its parts and a stream give the same figures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.folders import stored
from stratascope.operators.dependence import quantile_codes, transfer_entropy

#: A correlation below this counts as none; lags further than this share of the window measure its own mean; fewer pairs say nothing.
THRESHOLD, HORIZON, LEAST_PAIRS, LEAST_SAMPLES = 1 / math.e, 0.25, 4, 2.0
SIZES = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0)
AXES = {"row": ("x", "y"), "column": ("y", "x")}  # an axis, the lines along it, and the place on a line


def products(field: DataFrame, *keys: str) -> DataFrame:
    """keys, axis, size, lag, pairs, across, left, right: summed products of centred values so many cells apart, over all lines of a window."""
    mean = field.groupBy(*keys).agg(F.avg("value").alias("mean"))
    out = None
    for axis, (line, place) in AXES.items():
        values = F.transform(F.array_sort(F.collect_list(F.struct(place, "value"))), lambda c: c["value"])  # a line of one window
        lines = field.groupBy(*keys, line).agg(values.alias("v")).join(mean, list(keys)).withColumn("v", F.transform("v", lambda x: x - F.col("mean")))
        size = F.size("v")
        limit = F.floor(size * HORIZON).cast("int")
        each = lines.select(*keys, "v", size.alias("size"), F.explode(F.sequence(F.lit(0), limit)).alias("lag"))
        left, right = F.slice("v", F.lit(1), F.col("size") - F.col("lag")), F.slice("v", F.col("lag") + 1, F.col("size") - F.col("lag"))
        total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        own = each.select(*keys, F.lit(axis).alias("axis"), "size", "lag", (F.col("size") - F.col("lag")).cast("long").alias("pairs"), total(left, right).alias("across"), total(left, left).alias("left"), total(right, right).alias("right"))
        out = own if out is None else out.unionByName(own)
    return merged(out, *keys)


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """States of parts of the lines of the same windows, added up."""
    return states.groupBy(*keys, "axis", "size", "lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "across", "left", "right")])


def decorrelation(states: DataFrame, *keys: str) -> DataFrame:
    """keys, axis, size, decorrelation (null if saturated), saturated: the first lag whose correlation is below 1 / e, from ``products``.

    Only lags within a quarter of the window are searched: beyond, a window's own mean makes its values look independent.
    A constant window decorrelates at 1.
    """
    floor = F.sqrt(F.col("left") * F.col("right"))
    found = (F.col("lag") > 0) & (F.col("pairs") >= LEAST_PAIRS) & ((floor <= 0) | (F.abs(F.col("across") / floor) < THRESHOLD))
    first = F.min(F.when(found, F.struct("lag", F.when(floor <= 0, F.lit(1)).otherwise(F.col("lag")).alias("cells"))))
    return states.groupBy(*keys, "axis", "size").agg(first.alias("f")).select(*keys, "axis", "size", F.col("f.cells").alias("decorrelation"), F.col("f").isNull().alias("saturated"))


def effective_samples(lengths: DataFrame, *keys: str) -> DataFrame:
    """keys, effective, adequate: the window's area over its decorrelation area; null where an axis is saturated, and never a bound instead."""
    g = lengths.groupBy(*keys).agg(F.bool_or("saturated").alias("s"), F.product(F.col("size") / F.col("decorrelation")).alias("n"))
    effective = F.when(~F.col("s"), F.col("n"))
    return g.select(*keys, effective.alias("effective"), F.coalesce(effective >= LEAST_SAMPLES, F.lit(False)).alias("adequate"))


def crop_sizes(interior: int, fractions: tuple[float, ...] = SIZES) -> list[int]:
    if interior < 4:
        raise Refused("an interior has four cells or more along each side")
    return sorted({max(4, round(interior * f)) for f in fractions})


def crops(field: DataFrame, height: int, width: int, sizes: list[int]) -> DataFrame:
    """The field once for each concentric square window that a cell lies in, as ``crop``."""
    inside = lambda s: (F.col("y") >= (height - s) // 2) & (F.col("y") < (height - s) // 2 + s) & (F.col("x") >= (width - s) // 2) & (F.col("x") < (width - s) // 2 + s)
    own = F.array_compact(F.array(*[F.when(inside(s), F.lit(s)) for s in sizes]))
    return field.withColumn("crop", F.explode(own))


def crop_energies(field: DataFrame, height: int, width: int, sizes: list[int], *keys: str | Column) -> DataFrame:
    """keys, crop, energy, cells: the mean of squares in each window; one aggregation, for tables and streams alike."""
    return crops(field, height, width, sizes).groupBy(*keys, "crop").agg(F.avg(F.col("value") * F.col("value")).alias("energy"), F.count("value").alias("cells"))


def _whole(energies: DataFrame, frames: int) -> None:
    bad = energies.groupBy("crop", "channel").agg(F.count("*").alias("n"), F.bool_and(F.col("cells") == F.col("crop") * F.col("crop")).alias("whole")).where((F.col("n") != frames) | ~F.col("whole"))
    if rows := bad.limit(1).collect():
        raise Refused(f"window {rows[0]['crop']} of {rows[0]['channel']} lacks frames or cells: a curve over part of a record is another measurement")


def sampled_frames(frames: int, most: int = 16) -> list[int]:
    n = min(most, frames)
    return sorted({int(i * (frames - 1) / (n - 1)) if n > 1 else 0 for i in range(n)})


def attenuation(fields: DataFrame, height: int, width: int, frames: int, lag: int, bins: int = 6, fractions: tuple[float, ...] = SIZES) -> DataFrame:
    """crop, fraction, effective, te: the information that the source adds to the target, as a function of how much of the window is averaged.

    ``fields``: channel (source or target), frame (0 to ``frames`` - 1), y, x, value. Frames, bins and lag are the same for
    every window, so that only the averaging changes. ``effective`` is the median over an even sample of the source's
    frames, null where half of them or more are saturated.
    """
    interior = min(height, width)
    sizes = crop_sizes(interior, fractions)
    energies = stored(crop_energies(fields, height, width, sizes, "channel", "frame"), "energies")
    _whole(energies, frames)
    codes = stored(quantile_codes(energies, bins, "crop", "channel", value="energy").select("crop", "channel", "frame", "code"), "codes")
    out = None
    for s in sizes:  # a declared, short list
        te = transfer_entropy(codes.where(F.col("crop") == s).select("channel", "frame", "code"), [lag], frames).where("source = 'source'").select(F.lit(s).alias("crop"), "te")
        out = te if out is None else out.unionByName(te)
    sample = crops(fields.where((F.col("channel") == "source") & F.col("frame").isin(sampled_frames(frames))), height, width, sizes)
    samples = effective_samples(decorrelation(products(sample, "crop", "frame"), "crop", "frame"), "crop", "frame")
    middle = samples.groupBy("crop").agg(F.when(2 * F.count("effective") > F.count("*"), F.median("effective")).alias("effective"))
    return out.join(middle, "crop").select("crop", (F.col("crop") / F.lit(interior)).alias("fraction"), "effective", "te")

