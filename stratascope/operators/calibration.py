"""What chance alone brings close: curves of excess against null members, one simultaneous test, lower tails, cliques, pools.

Distances are rows (member, distance): member 0 is the record, the others are null draws. They are counted between declared
radii, where they are; everything after that is over a few radii and members.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.errors import Refused
from stratascope.operators.testing import harmonic, required_surrogates

#: The share of null pairs up to which a mixture is read, and how far its estimates may lie apart.
NULL_CAP, TOLERANCE = 0.25, 0.05
LEAST_TAIL, TAIL_PERCENTILE = 50, 5.0


def member_fractions(distances: DataFrame, radii: Sequence[float]) -> DataFrame:
    """member, radius, fraction: the share of a member's distances at or below each radius. One aggregation, however many radii."""
    own = sorted(set(map(float, radii)))
    if not own:
        raise Refused("a curve has one radius or more")
    place = sum(((F.col("distance") > r).cast("int") for r in own), F.lit(0))
    counts = distances.where("distance IS NOT NULL").groupBy("member", place.alias("at")).agg(F.count("*").alias("k"))
    grid = F.broadcast(distances.sparkSession.createDataFrame([(i, r) for i, r in enumerate(own)], "i int, radius double"))
    total = counts.groupBy("member").agg(F.sum("k").alias("n"))
    upto = counts.crossJoin(grid).groupBy("member", "radius").agg(F.sum(F.when(F.col("at") <= F.col("i"), F.col("k")).otherwise(0)).alias("k"))
    return upto.join(total, "member").select("member", "radius", (F.col("k") / F.col("n")).alias("fraction"))


def excess_curve(fractions: DataFrame) -> DataFrame:
    """radius, observed, null_mean, excess, p_value: the record's share against the members' mean, and how many members reach it.

    These p-values describe; a sweep of radii is tested as one by ``separation``.
    """
    of = lambda c: F.col("member") == 0 if c else F.col("member") != 0
    seen = fractions.withColumn("own", F.max(F.when(of(True), F.col("fraction"))).over(Window.partitionBy("radius")))  # a row a member
    g = seen.groupBy("radius").agg(F.max("own").alias("observed"), F.avg(F.when(of(False), F.col("fraction"))).alias("null_mean"), F.count_if(of(False) & (F.col("fraction") >= F.col("own"))).alias("k"), F.count_if(of(False)).alias("n"))
    return g.select("radius", "observed", "null_mean", (F.col("observed") - F.col("null_mean")).alias("excess"), ((1 + F.col("k")) / (1 + F.col("n"))).alias("p_value"))


def separation(fractions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """statistic, radius, p_value, critical, significant, members, swept: the largest excess anywhere, against each member's own over the mean of the others.

    The critical value, the higher order statistic at 1 - ``alpha``, holds at all radii at once. ``swept`` is how many
    members a corrected test radius by radius would need.
    """
    if not 0 < alpha < 1:
        raise Refused("a level lies between 0 and 1")
    if fractions.where("member <> 0").select("member").distinct().limit(2).count() < 2:
        raise Refused("a member is scored against the mean of others: two are needed")
    w = Window.partitionBy("radius")  # a row a member
    null = F.col("member") != 0
    total, n = F.sum(F.when(null, F.col("fraction"))).over(w), F.count_if(null).over(w)
    others = F.when(null, (total - F.col("fraction")) / (n - 1)).otherwise(total / n)
    best = fractions.select("member", "radius", (F.col("fraction") - others).alias("excess")).groupBy("member").agg(F.max("excess").alias("statistic"), F.min(F.struct((-F.col("excess")).alias("e"), "radius")).alias("at"))
    own = best.where("member = 0").select("statistic", F.col("at.radius").alias("radius"))
    nulls = best.where("member <> 0").select(F.col("statistic").alias("s"))
    place = F.ceil(F.round((1 - F.lit(alpha)) * (F.count("*") - 1), 9)).cast("int")
    summed = nulls.groupBy().agg(F.element_at(F.array_sort(F.collect_list("s")), place + 1).alias("critical"), F.count("*").cast("long").alias("members"), F.collect_list("s").alias("all"))  # a figure a member
    radii = fractions.select("radius").distinct().count()
    out = own.crossJoin(F.broadcast(summed)).withColumn("k", F.size(F.filter("all", lambda s: s >= F.col("statistic"))))
    p = (1 + F.col("k")) / (1 + F.col("members"))
    return out.select("statistic", "radius", p.alias("p_value"), "critical", (p <= alpha).alias("significant"), "members", F.lit(required_surrogates(radii, alpha, "by")).cast("long").alias("swept"))


def recurrence(curve: DataFrame, critical: float, cap: float = NULL_CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """fraction, read_at, spread, stable: the share of pairs beyond chance, excess / (1 - null share), where the excess is above the critical value and the null share within the cap.

    The median of the estimates; a single one is unstable, there being nothing to hold it against. Where there is none the
    largest excess is given, unstable.
    """
    if not (math.isfinite(critical) and 0 < cap < 1 and tolerance > 0):
        raise Refused("a finite critical value, a cap between 0 and 1 and a tolerance above 0 are needed")
    read = (F.col("excess") > critical) & (F.col("null_mean") <= cap)
    value = F.when(read, F.col("excess") / (1 - F.col("null_mean")))
    g = curve.groupBy().agg(F.count(value).alias("read_at"), F.median(value).alias("middle"), (F.max(value) - F.min(value)).alias("spread"), F.max("excess").alias("most"))
    return g.select(F.coalesce("middle", "most").alias("fraction"), "read_at", F.coalesce("spread", F.lit(0.0)).alias("spread"), ((F.col("read_at") >= 2) & (F.col("spread") <= tolerance)).alias("stable"))


@dataclass(frozen=True)
class Tail:
    threshold: float
    shape: float
    scale: float
    rate: float
    exceedances: int
    population: int


def lower_tail(distances: DataFrame, percentile: float = TAIL_PERCENTILE, least: int = LEAST_TAIL, grid: int = 64) -> Tail:
    """A generalised Pareto distribution of how far distances lie below a low percentile, by its profile likelihood.

    The likelihood depends on the data only through sums of log(1 + t x) for a ratio t of shape to scale. Each pass sums
    them for a grid of ratios at once and narrows the grid about the best. Refused where the tail is thin.
    """
    values = distances.where("distance IS NOT NULL AND NOT isnan(distance) AND abs(distance) < double('inf')").select(F.col("distance").cast("double").alias("d"))
    n, threshold = values.agg(F.count("*"), F.percentile("d", F.lit(percentile / 100))).first()
    if n < least:
        raise Refused(f"{n} distances are fewer than the {least} that a tail needs")
    tail = values.where(F.col("d") < threshold).select((F.lit(threshold) - F.col("d")).alias("x"))
    k, most, mean = tail.agg(F.count("*"), F.max("x"), F.avg("x")).first()
    if k < least:
        raise Refused(f"{k} exceedances are fewer than the {least} that a tail needs")
    low, high = -1 / most * (1 - 1e-6), 10 / mean
    best = (-math.inf, 0.0, 0.0)
    for _ in range(6):
        ratios = [low + (high - low) * i / (grid - 1) for i in range(grid)]
        ratios = [t for t in ratios if abs(t) > 1e-9 / mean] + [1e-9 / mean]
        sums = tail.agg(*[F.sum(F.log1p(t * F.col("x"))) for t in ratios]).first()
        for t, total in zip(ratios, sums):
            shape = total / k
            if shape / t > 0 and (value := -math.log(shape / t) - shape - 1) > best[0]:
                best = (value, t, shape)
        step = (high - low) / (grid - 1)
        low, high = max(-1 / most * (1 - 1e-9), best[1] - 2 * step), best[1] + 2 * step
    _, t, shape = best
    return Tail(threshold, shape, shape / t, k / n, k, n)


def tail_probability(distance: Column, tail: Tail) -> Column:
    """How rarely a distance as small comes by chance; 1 above the threshold, where the tail says nothing."""
    excess = F.lit(tail.threshold) - distance
    inside = 1 + tail.shape * excess / tail.scale
    survival = F.when(inside <= 0, 0.0).otherwise(F.exp(-F.log(inside) / tail.shape)) if abs(tail.shape) > 1e-9 else F.exp(-excess / tail.scale)
    return F.when(distance > tail.threshold, 1.0).otherwise(tail.rate * survival)


def expected_cliques(matchings: DataFrame) -> DataFrame:
    """``matchings`` (scenes, configurations a scene, edges) with a row a size: the one-per-scene sets, their pairs, and how many cliques independent edges would give.

    C(S, m) c^m p^C(m, 2), p being the share of cross-scene pairs that are edges. A pair is expected as often as there are edges.
    """
    if not matchings.where("scenes < 2 OR configurations < 1 OR edges < 0").isEmpty():
        raise Refused("two scenes, a configuration in each and no fewer than no edges are needed")
    s, c, m = (F.col(x).cast("double") for x in ("scenes", "configurations", "size"))
    choose = lambda n, k: F.round(F.exp(F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))))
    p = F.col("edges") / (s * (s - 1) / 2 * c * c)
    sized = matchings.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("scenes").cast("int"))))
    sets, needed = choose(s, m) * F.pow(c, m), m * (m - 1) / 2
    return sized.withColumn("sets", sets).withColumn("pairs", needed.cast("long")).withColumn("expected", F.col("sets") * F.pow(p, F.col("pairs")))


def least_pool(tests: int, alpha: float = 0.05, method: str = "by", corresponding: int | None = None) -> int:
    """The smallest pool of alternatives at which the correspondences that are real can be told by their floor 1 / (1 + n).

    By default all of them are. The fewer, the stricter the rank they are held to.
    """
    real = tests if corresponding is None else corresponding
    if tests < 1 or not 1 <= real <= tests:
        raise Refused("one real correspondence or more, and no more than are tested")
    # the real ones share the lowest p-value; what a step-up or step-down method multiplies it by
    factor = {"bonferroni": tests, "holm": tests, "bh": tests / real, "by": tests * harmonic(tests) / real}[method]
    return max(2, math.ceil(factor / alpha - 1e-9) - 1)
