"""Event series on a frame grid: windows, precursors, ordered chains, recurrence, co-occurrence.

A series is a table (pattern, frame) without repeats; the grid is the table (frame) of frames that were looked at. A
window counts only if it lies inside the grid's span and every frame of it was looked at; other anchors are set apart,
never counted as misses. Windows are closed at both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import stored

Lags = Sequence[tuple[int, int]]


def on_grid(events: DataFrame, pattern: Column, frame: Column) -> DataFrame:
    """Events as (pattern, frame), each frame of a pattern once."""
    return events.select(pattern.alias("pattern"), frame.cast("long").alias("frame")).where("pattern IS NOT NULL AND frame IS NOT NULL").distinct()


def observed_frames(series: DataFrame) -> DataFrame:
    """The frames at which anything was seen, as a grid."""
    return series.select("frame").distinct()


def lag_windows(spark, lags: Lags) -> DataFrame:
    """lo, hi, lag: each window's lags; a short table of literals."""
    return spark.createDataFrame([(lo, hi, k) for lo, hi in lags for k in range(lo, hi + 1)], "lo long, hi long, lag long")


def window_status(grid: DataFrame, lags: Lags) -> DataFrame:
    """lo, hi, frame, status of the window [frame + lo, frame + hi]: MEASURED, INCOMPLETE or TRUNCATED."""
    spark = grid.sparkSession
    ends = grid.agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    asked = grid.crossJoin(F.broadcast(lag_windows(spark, lags))).withColumn("at", F.col("frame") + F.col("lag"))
    seen = asked.join(grid.select(F.col("frame").alias("at"), F.lit(1).alias("seen")), "at", "left")
    counted = seen.groupBy("lo", "hi", "frame").agg(F.count("seen").alias("seen"), F.min("at").alias("start"), F.max("at").alias("end")).crossJoin(F.broadcast(ends))
    status = F.when((F.col("start") < F.col("first")) | (F.col("end") > F.col("last")), "TRUNCATED").when(F.col("seen") < F.col("hi") - F.col("lo") + 1, "INCOMPLETE").otherwise("MEASURED")
    return counted.select("lo", "hi", "frame", status.alias("status"))


def window_hits(series: DataFrame, lags: Lags) -> DataFrame:
    """lo, hi, pattern, frame: the frames whose window holds the pattern."""
    return series.crossJoin(F.broadcast(lag_windows(series.sparkSession, lags))).select("lo", "hi", "pattern", (F.col("frame") - F.col("lag")).alias("frame")).distinct()


def base_rates(series: DataFrame, grid: DataFrame, lags: Lags) -> DataFrame:
    """lo, hi, consequent, positions, hits, base_rate over all measured windows of the grid."""
    return _base_rates(series, window_status(grid, lags), window_hits(series, lags))


def _base_rates(series: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    measured = status.where("status = 'MEASURED'")
    positions = measured.groupBy("lo", "hi").agg(F.count("*").alias("positions"))
    hits = measured.join(found, ["lo", "hi", "frame"]).groupBy("lo", "hi", F.col("pattern").alias("consequent")).agg(F.count("*").alias("hits"))
    every = positions.crossJoin(series.select(F.col("pattern").alias("consequent")).distinct())
    out = every.join(hits, ["lo", "hi", "consequent"], "left").fillna(0, ["hits"])
    return out.withColumn("base_rate", F.col("hits") / F.col("positions"))


def precursor_counts(series: DataFrame, grid: DataFrame, lags: Lags) -> DataFrame:
    """Each ordered pair and window: anchors, eligible, support, confidence, base_rate and lift.

    ``anchors - eligible`` are those whose window wasn't fully seen.
    """
    status = stored(window_status(grid, lags), "status")
    anchors = series.select(F.col("pattern").alias("antecedent"), "frame").join(status, "frame")
    totals = anchors.groupBy("lo", "hi", "antecedent").agg(F.count("*").alias("anchors"), F.count_if(F.col("status") == "MEASURED").alias("eligible"))
    found = stored(window_hits(series, lags), "hits")
    hits = found.withColumnRenamed("pattern", "consequent")
    support = anchors.where("status = 'MEASURED'").join(hits, ["lo", "hi", "frame"]).groupBy("lo", "hi", "antecedent", "consequent").agg(F.count("*").alias("support"))
    pairs = totals.join(_base_rates(series, status, found), ["lo", "hi"]).where("antecedent <> consequent")
    out = pairs.join(support, ["lo", "hi", "antecedent", "consequent"], "left").fillna(0, ["support"])
    confidence = F.when(F.col("eligible") > 0, F.col("support") / F.col("eligible"))
    return out.select("antecedent", "consequent", "lo", "hi", "anchors", "eligible", "support", confidence.alias("confidence"), "base_rate", F.when(F.col("base_rate") > 0, confidence / F.col("base_rate")).alias("lift"))


def co_occurrences(series: DataFrame) -> DataFrame:
    """frame, patterns (in order, joined by +) of frames that hold more than one pattern."""
    both = series.groupBy("frame").agg(F.array_sort(F.collect_set("pattern")).alias("own"))
    return both.where(F.size("own") > 1).select("frame", F.array_join("own", "+").alias("patterns"))


def spans(series: DataFrame) -> DataFrame:
    """pattern, frame, gap: frames since the pattern's occurrence before."""
    return series.withColumn("gap", F.col("frame") - F.lag("frame").over(Window.partitionBy("pattern").orderBy("frame")))


def recurrence(series: DataFrame, least_spans: int = 2) -> DataFrame:
    """pattern, measured, modal_gap, modal_count, concentration; of equally common gaps the smallest, which must occur twice."""
    gaps = spans(series).where("gap IS NOT NULL").groupBy("pattern", "gap").agg(F.count("*").alias("n"))
    best = gaps.groupBy("pattern").agg(F.sum("n").alias("measured"), F.max_by(F.struct("gap", "n"), F.struct("n", -F.col("gap"))).alias("m"))
    out = best.where((F.col("measured") >= least_spans) & (F.col("m.n") >= 2))
    return out.select("pattern", "measured", F.col("m.gap").alias("modal_gap"), F.col("m.n").alias("modal_count"), (F.col("m.n") / F.col("measured")).alias("concentration"))


def chain_support(series: DataFrame, grid: DataFrame, length: int, lo: int, hi: int, least: int, budget: int = 10_000) -> DataFrame:
    """chain, eligible, support, confidence of ordered chains up to ``length`` patterns, each step lo to hi frames later.

    Level by level: a chain grows only from a chain with support of ``least`` or more. An anchor is eligible if the whole
    window [anchor + lo, anchor + (length - 1) * hi] was seen. More than ``budget`` candidates at a level are refused.
    """
    step = F.broadcast(lag_windows(series.sparkSession, [(lo, hi)]).select("lag"))
    reach = series.select(F.col("pattern").alias("chain"), F.col("frame").alias("anchor"), F.col("frame").alias("at"))
    out = None
    for k in range(2, length + 1):
        nxt = reach.crossJoin(step).select("chain", "anchor", (F.col("at") + F.col("lag")).alias("frame")).join(series, "frame")
        reach = stored(nxt.select(F.concat_ws(">", "chain", "pattern").alias("chain"), "anchor", F.col("frame").alias("at")).distinct(), "reach")
        measured = window_status(grid, [(lo, (k - 1) * hi)]).where("status = 'MEASURED'").select(F.col("frame").alias("anchor"))
        done = reach.select("chain", "anchor").distinct().join(measured, "anchor").groupBy("chain").agg(F.count("*").alias("support"))
        eligible = series.withColumnRenamed("frame", "anchor").join(measured, "anchor").groupBy(F.col("pattern").alias("first")).agg(F.count("*").alias("eligible"))
        level = done.withColumn("first", F.substring_index("chain", ">", 1)).join(eligible, "first").select("chain", F.lit(k).alias("length"), "eligible", "support", (F.col("support") / F.col("eligible")).alias("confidence"))
        level = stored(level, "level")
        if level.count() > budget:
            raise ValueError(f"more than {budget} candidate chains of length {k}")
        out = level if out is None else out.unionByName(level)
        reach = reach.join(level.where(F.col("support") >= least).select("chain"), "chain", "left_semi")
    return out


def circular_supports(length: int, a: list[int], b: list[int]) -> np.ndarray:
    """For every shift how many of the places ``a``, moved on round the circle, fall on places ``b``; by Fourier transforms."""
    one, other = np.zeros(length), np.zeros(length)
    one[a], other[b] = 1, 1
    return np.rint(np.fft.irfft(np.conj(np.fft.rfft(one)) * np.fft.rfft(other), length)).astype(np.int64)


def rotated_supports(series: DataFrame, grid: DataFrame, lo: int, hi: int, floor: int) -> DataFrame:
    """antecedent, consequent, shift, support: supports after moving the antecedent round the grid by every admissible shift.

    Shifts nearer than ``floor`` to either end are left out. The null is enumerated, not drawn: it needs no random numbers.
    A row a pair of patterns holds their places on the grid, a number an occurrence.
    """
    ends = grid.agg(F.min("frame").alias("first"), (F.max("frame") - F.min("frame") + 1).cast("int").alias("n"))
    measured = window_status(grid, [(lo, hi)]).where("status = 'MEASURED'").select("frame")
    hits = window_hits(series, [(lo, hi)]).join(measured, "frame")
    places = lambda df, name, at: df.crossJoin(F.broadcast(ends)).groupBy(F.col("pattern").alias(name), "n").agg(F.collect_list((F.col("frame") - F.col("first")).cast("int")).alias(at))
    pairs = places(series, "antecedent", "a").join(places(hits, "consequent", "b").drop("n"), F.col("antecedent") != F.col("consequent"))

    def rotate(batches):
        for rows in batches:
            for r in rows.itertuples():
                support = circular_supports(r.n, r.a, r.b)
                shift = np.arange(floor, r.n - floor + 1)
                yield pd.DataFrame({"antecedent": r.antecedent, "consequent": r.consequent, "shift": shift, "support": support[shift % r.n]})

    kind = series.schema["pattern"].dataType.simpleString()
    return pairs.mapInPandas(rotate, f"antecedent {kind}, consequent {kind}, shift long, support long")


def exact_null(series: DataFrame, grid: DataFrame, lo: int, hi: int, floor: int) -> DataFrame:
    """antecedent, consequent, observed, draws, reached, p_value with p = (1 + reached) / (1 + draws)."""
    measured = window_status(grid, [(lo, hi)]).where("status = 'MEASURED'").select("frame")
    hits = window_hits(series, [(lo, hi)]).select(F.col("pattern").alias("consequent"), "frame").join(measured, "frame")
    observed = series.withColumnRenamed("pattern", "antecedent").join(hits, "frame").where("antecedent <> consequent").groupBy("antecedent", "consequent").agg(F.count("*").alias("observed"))
    draws = grid.agg((F.max("frame") - F.min("frame") + 2 - 2 * floor).alias("draws"))
    reached = rotated_supports(series, grid, lo, hi, floor).join(observed, ["antecedent", "consequent"]).groupBy("antecedent", "consequent").agg(F.count_if(F.col("support") >= F.col("observed")).alias("reached"))
    out = observed.join(reached, ["antecedent", "consequent"], "left").fillna(0, ["reached"]).crossJoin(F.broadcast(draws))
    return out.withColumn("p_value", (1 + F.col("reached")) / (1 + F.col("draws")))


def scale_order(pairs: DataFrame) -> DataFrame:
    """pattern, low, high, middle: range and geometric mean of positive scales."""
    return pairs.where("scale > 0").groupBy("pattern").agg(F.min("scale").alias("low"), F.max("scale").alias("high"), F.exp(F.avg(F.log("scale"))).alias("middle"))


def ranked_rules(rules: DataFrame, by: str = "lift") -> DataFrame:
    """Rules of each consequent, best first; rules without a figure come last, ties by antecedent and window."""
    order = Window.partitionBy("consequent").orderBy(F.col(by).desc_nulls_last(), "antecedent", "lo", "hi")
    return rules.withColumn("rank", F.row_number().over(order))
