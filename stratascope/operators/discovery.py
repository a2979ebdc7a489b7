"""Configurations that recur over scenes, relations of two features, lags that physics allows, and bounds of distances."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import stored
from stratascope.functions.geometry import facing, wrapped_difference
from stratascope.operators.neighbours import subsets


def motif_occurrences(members: DataFrame, size: int, most: int) -> DataFrame:
    """scene, motif: each set of so many different members of a scene once; ``members`` has scene and member."""
    return subsets(members.distinct(), size, "scene", most=most).select("scene", F.col("members").alias("motif"))


def mined_motifs(occurrences: DataFrame, least: int) -> DataFrame:
    """motif, support: sets that occur in ``least`` scenes or more; ``occurrences`` has each set of a scene once, as ``motif_occurrences`` gives them."""
    return occurrences.where("scene IS NOT NULL").groupBy("motif").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def confirmed_motifs(occurrences: DataFrame, scenes: DataFrame, held_out: Column, least: int, most: int) -> DataFrame:
    """motif, support, share, rank, held_support, held_share, lift of the first ``most`` motifs of the other scenes, counted once in the held-out ones.

    ``lift`` is the held-out share over the one that was found; candidates are chosen without a look at the held-out scenes.
    """
    marked = occurrences.withColumn("held", held_out)
    n = scenes.select("scene").distinct().withColumn("held", held_out).agg(F.count_if(~F.col("held")).alias("n_found"), F.count_if("held").alias("n_held"))
    found = mined_motifs(marked.where("NOT held"), least)
    ranked = found.orderBy(F.desc("support"), "motif").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("support"), "motif")))  # ``most`` rows
    held = marked.where("held").join(F.broadcast(ranked.select("motif")), "motif").where("scene IS NOT NULL").groupBy("motif").agg(F.count("*").alias("held_support"))
    out = ranked.join(held, "motif", "left").fillna(0, ["held_support"]).crossJoin(F.broadcast(n))
    share, held_share = F.col("support") / F.col("n_found"), F.col("held_support") / F.col("n_held")
    return out.select("motif", "support", share.alias("share"), "rank", "held_support", held_share.alias("held_share"), (held_share / share).alias("lift"))


def relations(pairs: DataFrame, period: float, directed: bool = False) -> DataFrame:
    """``pairs`` of features a and b (structs of y, x, scale, extent, time, duration, angle) with how they stand to each other.

    distance and lag are in units of the geometric mean of both scales and durations; relative_scale is a's scale over b's.
    direction is the bearing of b from a, from rows to columns, less a's own angle, on a circle of ``period`` degrees; null
    where both are at one place. convergence, of directed angles only, is the sum of the cosines of each one's angle against
    the bearing to the other: above 0 both point inward. containment is how much of a's extent is left when b's and the
    distance are taken off, as a share; co_occur where the lag is 1 at most.
    """
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    dy, dx, elapsed = b("y") - a("y"), b("x") - a("x"), b("time") - a("time")
    apart, lag = F.sqrt(dy * dy + dx * dx), elapsed / F.sqrt(a("duration") * b("duration"))
    inside = (a("extent") - (apart + b("extent"))) / a("extent")
    bearing = lambda y, x: F.when(apart > 0, F.degrees(F.atan2(x, y)))
    turn = lambda bearing, angle: wrapped_difference(bearing, angle, period)
    circle = F.lit(float(period))
    inward = F.when(apart > 0, facing(dy, dx, a("angle"), circle) + facing(-dy, -dx, b("angle"), circle))
    more = {"convergence": inward, "converging": inward > 0} if directed else {}
    return pairs.withColumns({
        "distance": apart / F.sqrt(a("scale") * b("scale")),
        "relative_scale": a("scale") / b("scale"),
        "lag": lag,
        "direction": turn(bearing(dy, dx), a("angle")),
        "containment": inside,
        "contained": inside >= 0,
        "succession": F.signum(elapsed).cast("int"),
        "co_occur": F.abs(lag) <= 1,
        **more,
    })


def filter_support(taps: int, level: int) -> int:
    """Cells that a coefficient of the recursive transform sees along an axis."""
    return (taps - 1) * (2**level - 1) + 1


def interior_cells(field: DataFrame, height: int, width: int, taps: int, levels: int) -> DataFrame:
    """level, support, halfwidth, cells: how many cells of the field lie further from its edge than a level's filter reaches."""
    each = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(filter_support(taps, j)).alias("support"), F.lit(filter_support(taps, j) - 1).alias("halfwidth")) for j in range(1, levels + 1)])
    edge = F.least(F.col("y"), F.lit(height - 1) - F.col("y"), F.col("x"), F.lit(width - 1) - F.col("x"))
    return field.select(edge.alias("edge"), F.explode(each).alias("l")).select("edge", "l.*").groupBy("level", "support", "halfwidth").agg(F.count_if(F.col("edge") >= F.col("halfwidth")).alias("cells"))


def lag_floors(supports: DataFrame, cell_metres: Column, speed: float, cadence: float) -> DataFrame:
    """``supports`` (level, support) with floor: the fewest frames in which something of this speed crosses a level's filter."""
    return supports.withColumn("floor", F.ceil(F.round(F.col("support") * cell_metres / (speed * cadence), 9)).cast("long"))


def physical_lags(floors: DataFrame, lags: list[float], cadence: float) -> DataFrame:
    """``floors`` with lag_seconds, frames (null unless a whole number of them) and admissible (whole, and no less than the floor)."""
    asked = F.broadcast(floors.sparkSession.createDataFrame([(float(x),) for x in lags], "lag_seconds double"))
    frames = F.when(F.col("lag_seconds") % cadence == 0, (F.col("lag_seconds") / cadence).cast("long"))
    out = floors.crossJoin(asked).withColumn("frames", frames)
    return out.withColumn("admissible", F.coalesce(F.col("frames") >= F.col("floor"), F.lit(False)))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X < k) for X binomial."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return math.fsum(math.exp(log(i)) for i in range(min(k, n + 1)))


def tolerance_rank(n: int, coverage: float, confidence: float) -> int | None:
    """The least k such that the k-th smallest of n values lies above the share ``coverage`` with this confidence; None if there is none."""
    if 1 - coverage**n < confidence:
        return None
    low, high = 1, n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_below(mid, n, coverage) >= confidence else (mid + 1, high)
    return low


def tolerance_bounds(distances: DataFrame, coverage: float, confidence: float, *keys: str) -> DataFrame:
    """keys, n, quantile and bound, of the positive distances: the one at place ceil(coverage * n) in their order, and the least one above the share ``coverage`` with the confidence asked for (null where n is too small).

    Distances are counted by value, and places are running sums of these counts, so that no window orders rows that are alike.
    """

    @F.pandas_udf("long")
    def rank(n: pd.Series) -> pd.Series:
        return n.map(lambda x: tolerance_rank(int(x), coverage, confidence)).astype("Int64")

    counts = distances.where("distance > 0").groupBy(*keys, "distance").agg(F.count("*").alias("k"))
    size = counts.groupBy(*keys).agg(F.sum("k").alias("n")).withColumn("at", F.ceil(F.round(F.col("n") * coverage, 9))).withColumn("rank", rank("n"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("distance"))
    placed = counts.withColumn("upto", upto).join(size, list(keys)) if keys else counts.withColumn("upto", upto).crossJoin(size)
    holds = lambda place: F.min(F.when(F.col("upto") >= F.col(place), F.col("distance")))
    return placed.groupBy(*keys, "n").agg(holds("at").alias("quantile"), holds("rank").alias("bound"))


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share, by bisection on binomial tails."""
    tail = (1 - confidence) / 2

    def solve(high_enough) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if high_enough(mid) else (mid, high)
        return (low + high) / 2

    lower = 0.0 if successes == 0 else solve(lambda p: 1 - binomial_below(successes, trials, p) >= tail)
    upper = 1.0 if successes == trials else solve(lambda p: binomial_below(successes + 1, trials, p) <= tail)
    return lower, upper


def stationary_haar(field: DataFrame, height: int, width: int, levels: int) -> DataFrame:
    """level, y, x, ll, lh, hl, hh: undecimated Haar coefficients on a periodic grid; each level halves sums and differences at twice the distance."""
    out, now = None, field.select("y", "x", F.col("value").alias("v"))
    for j in range(1, levels + 1):
        d = 2 ** (j - 1)
        at = lambda dy, dx, name: now.select(F.pmod(F.col("y") - dy, F.lit(height)).alias("y"), F.pmod(F.col("x") - dx, F.lit(width)).alias("x"), F.col("v").alias(name))  # noqa: B023, E731
        four = now.join(at(0, d, "r"), ["y", "x"]).join(at(d, 0, "b"), ["y", "x"]).join(at(d, d, "c"), ["y", "x"])
        v, r, b, c = (F.col(n) for n in ("v", "r", "b", "c"))
        level = four.select(F.lit(j).alias("level"), "y", "x", ((v + r + b + c) / 4).alias("ll"), ((v - r + b - c) / 4).alias("lh"), ((v + r - b - c) / 4).alias("hl"), ((v - r - b + c) / 4).alias("hh"))
        level = stored(level, "level")  # joined four times by the next one
        out = level if out is None else out.unionByName(level)
        now = level.select("y", "x", F.col("ll").alias("v"))
    return out


def inverse_stationary_haar(coefficients: DataFrame, levels: int) -> DataFrame:
    """y, x, value: the coarsest averages and every level's differences added up."""
    low = F.when(F.col("level") == levels, F.col("ll")).otherwise(0.0)
    return coefficients.groupBy("y", "x").agg(F.sum(low + F.col("lh") + F.col("hl") + F.col("hh")).alias("value"))


def stationary_energies(coefficients: DataFrame, levels: int) -> DataFrame:
    """level (0 for the averages of the last one), energy, fraction of the level's differences."""
    each = coefficients.select("level", (F.col("lh") * F.col("lh") + F.col("hl") * F.col("hl") + F.col("hh") * F.col("hh")).alias("e"))
    last = coefficients.where(F.col("level") == levels).select(F.lit(0).alias("level"), (F.col("ll") * F.col("ll")).alias("e"))
    g = each.unionByName(last).groupBy("level").agg(F.sum("e").alias("energy"))
    return g.withColumn("fraction", F.col("energy") / F.sum("energy").over(Window.partitionBy()))
