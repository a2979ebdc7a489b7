"""Records on a clock: exact alignment, clock facts, lags, memory, embargo splits, calendars.

Records meet only on equal times. Nothing is interpolated, shifted or filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.errors import Refused


def seconds(time: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def align_exact(first: DataFrame, second: DataFrame, least: int = 1) -> DataFrame:
    """time, a, b where both records (time, value) have the time; fewer than ``least`` shared times are refused."""
    out = first.select("time", F.col("value").alias("a")).join(second.select("time", F.col("value").alias("b")), "time")
    if least > 1 and (n := out.count()) < least:
        raise Refused(f"the records share {n} times and {least} are asked for")
    return out


def alignment_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """shared, only_first, only_second: how many times both records, or one alone, have."""
    both = first.select("time", F.lit(1).alias("f")).distinct().join(second.select("time", F.lit(1).alias("s")).distinct(), "time", "full")
    return both.agg(F.count_if(F.col("f").isNotNull() & F.col("s").isNotNull()).alias("shared"), F.count_if(F.col("s").isNull()).alias("only_first"), F.count_if(F.col("f").isNull()).alias("only_second"))


def clock_facts(record: DataFrame, *keys: str) -> DataFrame:
    """n, least_step, most_step, median_step, repeated, regular of each key's times."""
    step = F.col("time") - F.lag("time").over(Window.partitionBy(*keys).orderBy("time"))
    steps = record.where("time IS NOT NULL").withColumn("step", step)
    out = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("step").alias("least_step"), F.max("step").alias("most_step"), F.percentile("step", F.lit(0.5)).alias("median_step"), F.count_if(F.col("step") == 0).alias("repeated"))
    return out.withColumn("regular", F.coalesce(F.col("least_step") == F.col("most_step"), F.lit(False)))


def cadence_record(record: DataFrame, expected: int, *keys: str) -> DataFrame:
    """step, n, as_expected: how often each interval occurs."""
    step = F.col("time") - F.lag("time").over(Window.partitionBy(*keys).orderBy("time"))
    return record.withColumn("step", step).where("step IS NOT NULL").groupBy(*keys, "step").agg(F.count("*").alias("n")).withColumn("as_expected", F.col("step") == expected)


def embargo_split(record: DataFrame, train: float, valid: float, embargo: int, *keys: str) -> DataFrame:
    """``record`` with its position and part: train, valid, test, or embargo for the rows dropped before each later part."""
    w = Window.partitionBy(*keys)
    at = record.withColumn("position", F.row_number().over(w.orderBy("time")) - 1).withColumn("_n", F.count("*").over(w))
    one, two = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + valid))
    p = F.col("position")
    part = F.when(p < one, "train").when(p < one + embargo, "embargo").when(p < two, "valid").when(p < two + embargo, "embargo").otherwise("test")
    return at.withColumn("part", part).drop("_n")


def lagged_correlations(record: DataFrame, lags: list[int]) -> DataFrame:
    """driver, driven, lag, n, r between channels of (frame, channel, value), the driven one lag frames later; no wrapping."""
    lag = F.broadcast(record.sparkSession.createDataFrame([(k,) for k in lags], "lag long"))
    ahead = record.select(F.col("channel").alias("driven"), "frame", F.col("value").alias("y")).crossJoin(lag).withColumn("frame", F.col("frame") - F.col("lag"))
    both = record.select(F.col("channel").alias("driver"), "frame", F.col("value").alias("x")).join(ahead, "frame").where("driver <> driven AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("driver", "driven", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def best_lags(correlations: DataFrame) -> DataFrame:
    """Each pair's lag of largest absolute correlation, the smallest of equal ones, and whether it exceeds that at lag 0."""
    order = Window.partitionBy("driver", "driven").orderBy(F.desc(F.round(F.abs("r"), 12)), "lag")
    zero = correlations.where("lag = 0").select("driver", "driven", F.abs("r").alias("r0"))
    best = correlations.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return best.join(zero, ["driver", "driven"], "left").withColumn("beyond_leakage", F.coalesce(F.abs("r") > F.col("r0"), F.lit(True)) & (F.col("lag") > 0)).drop("r0")


def lag_one(record: DataFrame, *keys: str) -> DataFrame:
    """n, r1 (about the whole record's mean, over its sum of squares) of each key's values in frame order."""
    centred = record.where("value IS NOT NULL").withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    nxt = centred.withColumn("w", F.lag("v").over(Window.partitionBy(*keys).orderBy("frame")))
    m = nxt.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("w")).alias("c"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return m.select(*keys, "n", F.when(F.col("q") > 0, F.col("c") / F.col("q")).alias("r1"))


def memory(record: DataFrame, *keys: str) -> DataFrame:
    """n, r1 and the memory (1 + r1) / (1 - r1), r1 held to [0, 0.999]."""
    r = F.least(F.greatest(F.coalesce("r1", F.lit(0.0)), F.lit(0.0)), F.lit(0.999))
    return lag_one(record, *keys).withColumn("memory", (1 + r) / (1 - r))


def effective_sizes(record: DataFrame, key: str = "channel") -> DataFrame:
    """left, right, n_effective = n (1 - r r') / (1 + r r'), at least 3, for every pair of channels."""
    m = lag_one(record, key)
    a, b = m.select(F.col(key).alias("left"), F.col("n"), F.col("r1").alias("ra")), m.select(F.col(key).alias("right"), F.col("r1").alias("rb"))
    r = F.least(F.greatest(F.col("ra") * F.col("rb"), F.lit(-0.999)), F.lit(0.999))
    return a.join(F.broadcast(b) if m.count() <= 100_000 else b, F.col("left") < F.col("right")).select("left", "right", F.greatest(F.lit(3.0), F.col("n") * (1 - r) / (1 + r)).alias("n_effective"))


def autocorrelations(record: DataFrame, most: int, *keys: str) -> DataFrame:
    """lag, acf up to ``most`` of each key's values on an integer frame clock, over the whole record's sum of squares."""
    w = Window.partitionBy(*keys)
    v = record.where("value IS NOT NULL").withColumn("v", F.col("value") - F.avg("value").over(w)).select(*keys, "frame", "v")
    total = v.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    later = v.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"), "frame", F.col("v").alias("u")).withColumn("frame", F.col("frame") - F.col("lag"))
    return v.join(later, [*keys, "frame"]).groupBy(*keys, "lag").agg(F.sum(F.col("v") * F.col("u")).alias("c")).join(total, list(keys)).select(*keys, "lag", (F.col("c") / F.col("q")).alias("acf"))


def decorrelation(record: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first lag whose autocorrelation is below 1/e in size, or ``most`` where none is."""
    acf = autocorrelations(record, most, *keys)
    return acf.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.abs("acf") < 1 / 2.718281828459045, F.col("lag"))), F.lit(most)).cast("long").alias("decorrelation"))


def stationarity(record: DataFrame, *keys: str) -> DataFrame:
    """n, variance_ratio of the later to the earlier half, and the slope of value on frame."""
    w = Window.partitionBy(*keys)
    half = record.where("value IS NOT NULL").withColumn("_i", F.row_number().over(w.orderBy("frame"))).withColumn("_n", F.count("*").over(w))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = half.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(F.when(~early, F.col("value"))).alias("late"), F.var_pop(F.when(early, F.col("value"))).alias("early"), F.regr_slope("value", F.col("frame").cast("double")).alias("slope"))
    return out.select(*keys, "n", F.when(F.col("early") > 0, F.col("late") / F.col("early")).alias("variance_ratio"), "slope")


def anomalies(record: DataFrame, phase: Column, *keys: str) -> DataFrame:
    """``record`` with anomaly: value less the mean of its key and phase of the calendar."""
    w = Window.partitionBy(*keys, "_phase")
    return record.withColumn("_phase", phase).withColumn("anomaly", F.col("value") - F.avg("value").over(w)).drop("_phase")


def harmonic_climatology(record: DataFrame, period: float, *keys: str) -> DataFrame:
    """Mean, sine and cosine coefficients of one harmonic, least squares for each key over its own normal equations."""
    t = F.col("frame") * (2 * 3.141592653589793 / period)
    m = record.where("value IS NOT NULL").select(*keys, F.sin(t).alias("s"), F.cos(t).alias("c"), "value")
    sums = {"n": F.count("*"), "s": F.sum("s"), "c": F.sum("c"), "ss": F.sum(F.col("s") * F.col("s")), "cc": F.sum(F.col("c") * F.col("c")), "sc": F.sum(F.col("s") * F.col("c")), "y": F.sum("value"), "sy": F.sum(F.col("s") * F.col("value")), "cy": F.sum(F.col("c") * F.col("value"))}
    g = m.groupBy(*keys).agg(*[e.alias(f"_{k}") for k, e in sums.items()])
    n, s, c, ss, cc, sc, y, sy, cy = (F.col(f"_{k}") for k in sums)
    # Centred sums leave two equations.
    a, b, d, p, q = ss - s * s / n, sc - s * c / n, cc - c * c / n, sy - s * y / n, cy - c * y / n
    det = a * d - b * b
    sine, cosine = F.when(F.abs(det) > 1e-9, (p * d - q * b) / det), F.when(F.abs(det) > 1e-9, (q * a - p * b) / det)
    return g.select(*keys, (y / n - sine * s / n - cosine * c / n).alias("mean"), sine.alias("sine"), cosine.alias("cosine"))


def normalisation(record: DataFrame, train: Column, *keys: str) -> DataFrame:
    """n, mean and population deviation of each key over its training rows only."""
    return record.where(train).groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
