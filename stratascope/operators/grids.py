"""Gridded fields as long tables (frame, y, x, value): weights, errors, derivatives, rings, wavelets, concentration.

Neighbours meet by equi-joins on shifted integer positions, so that a frame may be spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.functions.geometry import dx_metres, dy_metres, wrapped_difference


def crop(field: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Rows and columns of [low, high), counted from the crop's corner."""
    inside = field.where(F.col("y").between(y[0], y[1] - 1) & F.col("x").between(x[0], x[1] - 1))
    return inside.withColumn("y", F.col("y") - y[0]).withColumn("x", F.col("x") - x[0])


def weighted_moments(field: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """keys, mean, variance, deviation of the value, by weight; missing values carry none."""
    w = F.when(F.col("value").isNotNull(), weight)
    m = field.withColumn("_w", w).groupBy(*keys).agg(F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("value")).alias("s1"), F.sum(F.col("_w") * F.col("value") * F.col("value")).alias("s2"))
    mean = F.col("s1") / F.col("s")
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("s") - mean * mean)
    return m.select(*keys, mean.alias("mean"), var.alias("variance"), F.sqrt(var).alias("deviation"))


def weighted_errors(pairs: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """keys, rmse, mae, bias and their weighted forms of forecast against truth, and the ratio of the two RMSEs."""
    e = F.col("forecast") - F.col("truth")
    rows = pairs.withColumn("_e", e).withColumn("_w", weight).where("_e IS NOT NULL")
    w, d = F.col("_w"), F.col("_e")
    out = rows.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("weighted_rmse"), (F.sum(w * F.abs(d)) / F.sum(w)).alias("weighted_mae"), (F.sum(w * d) / F.sum(w)).alias("weighted_bias"))
    return out.withColumn("effect", F.when(F.col("rmse") == 0, 1.0).otherwise(F.col("weighted_rmse") / F.col("rmse")))


def boundary_rings(pairs: DataFrame, height: int, width: int, *keys: str) -> DataFrame:
    """keys, ring (cells from the edge), n, rmse, mae."""
    ring = F.least(F.col("y"), F.lit(height - 1) - F.col("y"), F.col("x"), F.lit(width - 1) - F.col("x"))
    e = F.col("forecast") - F.col("truth")
    return pairs.withColumn("ring", ring).groupBy(*keys, "ring").agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def shifted(field: DataFrame, dy: int, dx: int, name: str, *keys: str) -> DataFrame:
    """The value dy rows and dx columns further on, under ``name``, at each cell."""
    return field.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("value").alias(name))


def _with_neighbours(field: DataFrame, offsets: dict[str, tuple[int, int]], keys: tuple[str, ...], how: str = "left") -> DataFrame:
    return reduce(lambda df, kv: df.join(shifted(field, *kv[1], kv[0], *keys), [*keys, "y", "x"], how), offsets.items(), field)


def gradient(field: DataFrame, latitude: Column, dlat: float, dlon: float, *keys: str) -> DataFrame:
    """keys, y, x, north, east, magnitude, direction: central differences in units a metre; cells at the edge have none.

    East is null where a row's spacing vanishes, at the poles.
    """
    n = _with_neighbours(field, {"_n": (1, 0), "_s": (-1, 0), "_e": (0, 1), "_w": (0, -1)}, keys)
    across = dx_metres(latitude, dlon)
    north, east = (F.col("_n") - F.col("_s")) / (2 * dy_metres(dlat)), F.when(across > 1.0, (F.col("_e") - F.col("_w")) / (2 * across))
    out = n.select(*keys, "y", "x", north.alias("north"), east.alias("east"))
    return out.withColumn("magnitude", F.sqrt(F.col("north") * F.col("north") + F.col("east") * F.col("east"))).withColumn("direction", F.atan2("north", "east"))


def gradient_errors(forecast: DataFrame, truth: DataFrame, latitude: Column, dlat: float, dlon: float, *keys: str) -> DataFrame:
    """keys, n, magnitude_mae, direction_mae (round the circle) of the two fields' gradients."""
    a = gradient(forecast, latitude, dlat, dlon, *keys).select(*keys, "y", "x", F.col("magnitude").alias("m"), F.col("direction").alias("d"))
    both = a.join(gradient(truth, latitude, dlat, dlon, *keys), [*keys, "y", "x"]).where("m IS NOT NULL AND magnitude IS NOT NULL")
    turn = F.abs(wrapped_difference(F.col("d"), F.col("direction"), 2 * 3.141592653589793))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("m") - F.col("magnitude"))).alias("magnitude_mae"), F.avg(turn).alias("direction_mae"))


def laplacian(field: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, laplacian on the unit grid, where all four neighbours have a value."""
    n = _with_neighbours(field, {"_n": (1, 0), "_s": (-1, 0), "_e": (0, 1), "_w": (0, -1)}, keys, "inner")
    return n.select(*keys, "y", "x", (F.col("_n") + F.col("_s") + F.col("_e") + F.col("_w") - 4 * F.col("value")).alias("laplacian")).where("laplacian IS NOT NULL")


def haar(field: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, ll, lh, hl, hh: one level of the orthonormal Haar transform; incomplete blocks are left out."""
    block = field.withColumn("_y", F.floor(F.col("y") / 2)).withColumn("_x", F.floor(F.col("x") / 2))
    odd_y, odd_x = F.col("y") % 2 == 1, F.col("x") % 2 == 1
    v = F.col("value")
    signed = lambda flip: F.sum(F.when(flip, -v).otherwise(v)) / 2
    g = block.groupBy(*keys, "_y", "_x").agg(F.count("value").alias("_n"), (F.sum(v) / 2).alias("ll"), signed(odd_x).alias("lh"), signed(odd_y).alias("hl"), signed(odd_y != odd_x).alias("hh"))
    return g.where("_n = 4").select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), "ll", "lh", "hl", "hh")


def haar_energies(field: DataFrame, levels: int, *keys: str) -> DataFrame:
    """keys, level, band, n, energy, density, fraction of each frame's energy; a frame without energy has no fractions."""
    out, now = None, field.select(*keys, "y", "x", "value")
    for level in range(1, levels + 1):
        made = haar(now, *keys)
        bands = made.select(*keys, F.lit(level).alias("level"), F.expr("stack(3, 'lh', lh, 'hl', hl, 'hh', hh) AS (band, c)"))
        out = bands if out is None else out.unionByName(bands)
        now = made.select(*keys, "y", "x", F.col("ll").alias("value"))
    rest = now.select(*keys, F.lit(levels).alias("level"), F.lit("ll").alias("band"), F.col("value").alias("c"))
    e = out.unionByName(rest).groupBy(*keys, "level", "band").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("energy"))
    total = F.sum("energy").over(Window.partitionBy(*keys)) if keys else F.sum("energy").over(Window.partitionBy(F.lit(1)))
    return e.withColumn("density", F.col("energy") / F.col("n")).withColumn("fraction", F.when(total > 0, F.col("energy") / total))


def inverse_haar(bands: DataFrame, *keys: str) -> DataFrame:
    """The field that ``haar`` came from."""
    ll, lh, hl, hh = (F.col(c) for c in ("ll", "lh", "hl", "hh"))
    cells = F.array(*[F.struct((2 * F.col("y") + i).alias("y"), (2 * F.col("x") + j).alias("x"), ((ll + (1 - 2 * j) * lh + (1 - 2 * i) * hl + (1 - 2 * i) * (1 - 2 * j) * hh) / 2).alias("value")) for i in (0, 1) for j in (0, 1)])
    return bands.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def haar_detail(record: DataFrame, scale: int, *keys: str) -> DataFrame:
    """keys, frame, approximation, detail of the undecimated Haar transform of a series at one scale; no wrapping."""
    w = Window.partitionBy(*keys).orderBy("frame")
    later = F.lead("value", scale).over(w)
    return record.select(*keys, "frame", ((F.col("value") + later) / 2).alias("approximation"), ((F.col("value") - later) / 2).alias("detail")).where("detail IS NOT NULL")


def pooled(field: DataFrame, k: int, *keys: str) -> DataFrame:
    """Means over blocks of k by k cells."""
    return field.groupBy(*keys, F.floor(F.col("y") / k).alias("y"), F.floor(F.col("x") / k).alias("x")).agg(F.avg("value").alias("value"))


def time_anomalies(field: DataFrame) -> DataFrame:
    """``field`` with anomaly: value less the cell's mean over time."""
    return field.withColumn("anomaly", F.col("value") - F.avg("value").over(Window.partitionBy("y", "x")))


def participation(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """keys, n, participation = (sum w)^2 / (n sum w^2)."""
    g = rows.withColumn("_w", weight).where("_w IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("_w")).alias("q"))
    return g.select(*keys, "n", F.when(F.col("q") > 0, F.col("s") * F.col("s") / (F.col("n") * F.col("q"))).alias("participation"))


def gini(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """keys, n, gini = 2 sum i w(i) / (n sum w) - (n + 1) / n.

    Ranks come from counts of equal weights, so that a group is summed over its distinct weights in order.
    """
    each = rows.withColumn("_w", weight).where("_w IS NOT NULL").groupBy(*keys, "_w").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    at = each.withColumn("_b", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    ranks = F.col("_k") * F.col("_b") + F.col("_k") * (F.col("_k") + 1) / 2
    g = at.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(F.col("_w") * ranks).alias("i"), F.sum(F.col("_w") * F.col("_k")).alias("s"))
    return g.select(*keys, "n", F.when(F.col("s") > 0, 2 * F.col("i") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def scale_signature(coefficients: DataFrame, sigma: float = 3.0) -> DataFrame:
    """frame, scale, n, density, fraction, participation, beyond: (frame, scale, c); the threshold is pooled over frames.

    Fractions share out the densities of a frame's scales.
    """
    e = F.col("c") * F.col("c")
    pooled_rms = coefficients.groupBy("scale").agg((sigma * F.sqrt(F.avg(e))).alias("threshold"))
    rows = coefficients.join(pooled_rms, "scale")
    g = rows.groupBy("frame", "scale").agg(F.count("c").alias("n"), F.avg(e).alias("density"), F.sum(e).alias("s"), F.sum(e * e).alias("q"), F.avg((F.abs("c") > F.col("threshold")).cast("int")).alias("beyond"))
    total = F.sum("density").over(Window.partitionBy("frame"))
    return g.select("frame", "scale", "n", "density", F.when(total > 0, F.col("density") / total).alias("fraction"), F.when(F.col("q") > 0, F.col("s") * F.col("s") / (F.col("n") * F.col("q"))).alias("participation"), "beyond")


def dominant_scale(signature: DataFrame) -> DataFrame:
    """frame, scale of the largest density; of equal ones the smallest scale."""
    return signature.groupBy("frame").agg(F.max_by("scale", F.struct("density", -F.col("scale"))).alias("scale"))


def local_maxima(field: DataFrame, sigma: float, *keys: str) -> DataFrame:
    """Cells above all neighbours that exist and above sigma times the pooled RMS of all frames."""
    rms = field.agg((sigma * F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("threshold"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = field.select(*keys, F.explode(around).alias("o"), "y", "x", "value").select(*keys, (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x"), "value")
    highest = near.groupBy(*keys, "y", "x").agg(F.max("value").alias("highest"))
    return field.join(highest, [*keys, "y", "x"], "left").crossJoin(F.broadcast(rms)).where("value > threshold AND (highest IS NULL OR value > highest)").select(*keys, "y", "x", "value")


def top_features(maxima: DataFrame, most: int, *keys: str) -> DataFrame:
    """The ``most`` largest maxima of each key with their rank; ties by position."""
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "y", "x")
    return maxima.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def loglog_fit(points: DataFrame, *keys: str) -> DataFrame:
    """keys, n, slope, intercept, slope_error of ln y on ln x by weight w, over positive points; four points at least."""
    p = points.where("x > 0 AND y > 0 AND w > 0").withColumn("_a", F.log("x")).withColumn("_b", F.log("y"))
    a, b, w = F.col("_a"), F.col("_b"), F.col("w")
    g = p.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * a * b).alias("sab"), F.sum(w * b * b).alias("sbb"))
    s, sa, sb, saa, sab, sbb, n = (F.col(c) for c in ("s", "sa", "sb", "saa", "sab", "sbb", "n"))
    det = s * saa - sa * sa
    slope = (s * sab - sa * sb) / det
    icept = (sb - slope * sa) / s
    left = sbb - icept * sb - slope * sab
    return g.where((n >= 4) & (det > 0)).select(*keys, "n", slope.alias("slope"), icept.alias("intercept"), F.sqrt(F.greatest(F.lit(0.0), left) / (n - 2) * s / det).alias("slope_error"))


def chunk_amplification(cells: DataFrame, wanted: Column, chunk: dict[str, int]) -> DataFrame:
    """wanted, touched, amplification: cells asked for, and cells of the chunks that hold any of them."""
    ids = [F.floor(F.col(c) / k).alias(f"_{c}") for c, k in chunk.items()]
    per = cells.groupBy(*ids).agg(F.count("*").alias("n"), F.count_if(wanted).alias("k"))
    return per.agg(F.sum("k").alias("wanted"), F.sum(F.when(F.col("k") > 0, F.col("n")).otherwise(0)).alias("touched")).withColumn("amplification", F.when(F.col("wanted") > 0, F.col("touched") / F.col("wanted")))
