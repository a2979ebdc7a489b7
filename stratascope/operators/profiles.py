"""Irregular profiles: quality selection, monotonic checks, depth bins, bracketed interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admitted(adjusted: Column, adjusted_qc: Column, raw: Column, raw_qc: Column, good: Sequence = (1, 2)) -> Column:
    """The adjusted value if its flag is good, else the raw one if its flag is, else null."""
    return F.coalesce(F.when(adjusted_qc.isin(*good), adjusted), F.when(raw_qc.isin(*good), raw))


def strict_profiles(levels: DataFrame, low: float, high: float, profile: str = "profile") -> DataFrame:
    """Levels within [low, high] of profiles whose pressure strictly increases there, in the order of ``seq``."""
    inside = levels.where(F.col("pressure").between(low, high))
    step = F.col("pressure") - F.lag("pressure").over(Window.partitionBy(profile).orderBy("seq"))
    bad = F.max(F.coalesce(F.col("_step") <= 0, F.lit(False)).cast("int")).over(Window.partitionBy(profile))
    return inside.withColumn("_step", step).withColumn("_bad", bad).where("_bad = 0").drop("_step", "_bad")


def depth_bins(levels: DataFrame, edges: Sequence[float], *keys: str) -> DataFrame:
    """keys, bin, n, mean of the values in [low, high), the last bin closed; bins without values are null."""
    spark, n = levels.sparkSession, len(edges) - 1
    inside = [(F.col("pressure") >= edges[i]) & ((F.col("pressure") < edges[i + 1]) if i < n - 1 else (F.col("pressure") <= edges[-1])) for i in range(n)]
    bin_ = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)])
    got = levels.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    bins = F.broadcast(spark.createDataFrame([(i,) for i in range(n)], "bin int"))
    return levels.select(*keys).distinct().crossJoin(bins).join(got, [*keys, "bin"], "left").fillna(0, ["n"])


def at_level(levels: DataFrame, target: float, most_gap: float, *keys: str) -> DataFrame:
    """keys, value at ``target``: an exact level, or linear between neighbours no more than ``most_gap`` apart; never beyond them."""
    got = levels.where("value IS NOT NULL")
    low = F.max(F.when(F.col("pressure") <= target + 1e-9, F.struct("pressure", "value")))
    high = F.min(F.when(F.col("pressure") >= target - 1e-9, F.struct("pressure", "value")))
    g = got.groupBy(*keys).agg(low.alias("a"), high.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    gap = F.col("b.pressure") - F.col("a.pressure")
    value = F.when(gap <= 1e-9, F.col("a.value")).when(gap <= most_gap, F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (target - F.col("a.pressure")) / gap)
    return g.select(*keys, value.alias("value")).where("value IS NOT NULL")


def platforms_with(rows: DataFrame, least: int, platform: str) -> DataFrame:
    """Rows of platforms that have ``least`` values or more."""
    return rows.withColumn("_n", F.count("value").over(Window.partitionBy(platform))).where(F.col("_n") >= least).drop("_n")


def deepest(rows: DataFrame, depth: Column, *keys: str, order: str = "seq") -> DataFrame:
    """Each key's row of greatest depth, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_d"), order)
    return rows.withColumn("_d", depth).where("_d IS NOT NULL").withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_d", "_i")


def census(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """reason, n: the first rule that each row fails, in order, or accepted."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit("accepted"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
