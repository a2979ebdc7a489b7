"""Forecasts against truth: skill over persistence, ensembles, ranks, agreement of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matched_truth(forecast: DataFrame, truth: DataFrame, *cell: str) -> DataFrame:
    """forecast (init, lead, cell, forecast) with the truth (time, cell, value) at init + lead exactly."""
    return forecast.withColumn("time", F.col("init") + F.col("lead")).join(truth.select("time", *cell, F.col("value").alias("truth")), ["time", *cell])


def persistence_skill(record: DataFrame, leads: list[int], *cell: str) -> DataFrame:
    """lead, n, rmse, mae, bias of a forecast column, and its skill 1 - MSE / MSE of persistence.

    record: frame, cell, value, forecast (made at frame for frame + lead with the value then known).
    """
    lead = F.broadcast(record.sparkSession.createDataFrame([(k,) for k in leads], "lead long"))
    now = record.select(*cell, "frame", F.col("value").alias("held"), "forecast").crossJoin(lead).withColumn("frame", F.col("frame") + F.col("lead"))
    both = now.join(record.select(*cell, "frame", F.col("value").alias("truth")), [*cell, "frame"])
    e, p = F.col("forecast") - F.col("truth"), F.col("held") - F.col("truth")
    g = both.groupBy("lead").agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(p * p).alias("base"))
    return g.select("lead", "n", F.sqrt("mse").alias("rmse"), "mae", "bias", F.when(F.col("base") > 0, 1 - F.col("mse") / F.col("base")).alias("skill"))


def crps(members: DataFrame, *case: str) -> DataFrame:
    """case, members, crps: mean |x - y| - sum (2i - M - 1) x(i) / M^2 of members (case, value, truth)."""
    w = Window.partitionBy(*case)
    at = members.withColumn("_i", F.row_number().over(w.orderBy("value"))).withColumn("_m", F.count("*").over(w))
    m = F.col("_m").cast("double")
    return at.groupBy(*case).agg(F.count("*").alias("members"), (F.avg(F.abs(F.col("value") - F.col("truth"))) - F.sum((2 * F.col("_i") - F.col("_m") - 1) * F.col("value") / (m * m))).alias("crps"))


def rank_histogram(members: DataFrame, *case: str) -> DataFrame:
    """rank, share: where truth falls among the members, ties spread evenly over the ranks they allow."""
    g = members.groupBy(*case).agg(F.count_if(F.col("value") < F.col("truth")).alias("under"), F.count_if(F.col("value") == F.col("truth")).alias("equal"))
    each = g.select("equal", F.explode(F.sequence(F.col("under"), F.col("under") + F.col("equal"))).alias("rank"))
    return each.groupBy("rank").agg(F.sum(1 / (F.col("equal") + 1)).alias("share"))


def spread_skill(members: DataFrame, weight: Column, *case: str) -> DataFrame:
    """n, spread (RMS population spread), rmse of the mean, ratio; by weight."""
    g = members.groupBy(*case).agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"), F.first("truth").alias("t")).withColumn("_w", weight)
    e = F.col("m") - F.col("t")
    out = g.agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("spread"), F.sqrt(F.sum(F.col("_w") * e * e) / F.sum("_w")).alias("rmse"))
    return out.withColumn("ratio", F.when(F.col("rmse") > 0, F.col("spread") / F.col("rmse")))


def errors_by(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, n, rmse, mae, bias of forecast against truth."""
    e = F.col("forecast") - F.col("truth")
    return pairs.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def compare_sources(first: DataFrame, second: DataFrame, on: list[str], rtol: float, atol: float) -> DataFrame:
    """shared, mismatched, most, mean_abs, rmse between the values of two sources at the same cells."""
    d = F.abs(F.col("a") - F.col("b"))
    both = first.select(*on, F.col("value").alias("a")).join(second.select(*on, F.col("value").alias("b")), on)
    return both.agg(F.count("*").alias("shared"), F.count_if(d > atol + rtol * F.abs("b")).alias("mismatched"), F.max(d).alias("most"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"))


def compare_rows(observed: DataFrame, recorded: DataFrame, key: str, tolerance: float) -> DataFrame:
    """verdict, n: agrees, differs, only_observed or only_recorded, row by row."""
    both = observed.select(key, F.col("value").alias("a"), F.lit(1).alias("o")).join(recorded.select(key, F.col("value").alias("b"), F.lit(1).alias("r")), key, "full")
    verdict = F.when(F.col("r").isNull(), "only_observed").when(F.col("o").isNull(), "only_recorded").when(F.abs(F.col("a") - F.col("b")) <= tolerance, "agrees").otherwise("differs")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def join_segments(left: DataFrame, right: DataFrame, on: list[str], tolerance: float) -> DataFrame:
    """Both segments' rows without the right one's share of the seam; differing seam values make it refuse, as column ok."""
    seam = left.select(*on, F.col("value").alias("_l")).join(right.select(*on, F.col("value").alias("_r")), on)
    bad = seam.agg(F.count_if(F.abs(F.col("_l") - F.col("_r")) > tolerance).alias("bad"))
    return left.unionByName(right.join(left.select(*on), on, "left_anti")).crossJoin(F.broadcast(bad)).withColumn("ok", F.col("bad") == 0).drop("bad")
