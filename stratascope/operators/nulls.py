"""Surrogates of a record and tests against them.

A record is a table (channel, frame, value); surrogates keep its frames and gaps and move the values among its rows. What is
drawn comes from a hash of seed, draw and place, so that any engine can repeat it and no task needs a random state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.errors import Refused
from stratascope.folders import stored


def drawn(*parts: Column) -> Column:
    """A whole number of 48 bits from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def ranked(record: DataFrame, *keys: str) -> DataFrame:
    """``record`` with the row's place from 0 and the number of rows, within the keys."""
    w = Window.partitionBy(*keys)
    return record.withColumn("at", F.row_number().over(w.orderBy("frame")) - 1).withColumn("size", F.count("*").over(w))


def _draws(record: DataFrame, draws: int) -> DataFrame:
    return F.broadcast(record.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw")))


def _moved(rows: DataFrame, shift: Column, draws: int, *keys: str) -> DataFrame:
    """draw, channel, frame, value: each row's value stands ``shift`` rows later, round the end, within its keys."""
    out = rows.crossJoin(_draws(rows, draws)).withColumn("to", (F.col("at") + shift) % F.col("size"))
    places = rows.select(*keys, F.col("at").alias("to"), F.col("frame").alias("new"))
    return out.join(places, [*keys, "to"]).select("draw", "channel", F.col("new").alias("frame"), "value")


def _least_size(rows: DataFrame, *keys: str) -> int:
    """Rows of the shortest record; a record of fewer than two has nothing to shift between."""
    least = rows.groupBy(*keys).count().agg(F.min("count")).first()[0]
    if least is not None and least < 2:
        raise Refused("a null needs two rows or more of every channel")
    return least or 0


def circular_clock_shift(record: DataFrame, draws: int, floor: int, seed: int) -> DataFrame:
    """draw, channel, frame, value: a channel's values rolled by ``floor`` rows or more from either end."""
    if 0 < _least_size(record, "channel") < 2 * floor:
        raise Refused(f"a record is too short for a shift by {floor} rows from either end")
    shift = F.lit(floor) + drawn(F.lit(seed), F.col("draw"), F.col("channel")) % F.greatest(F.lit(1), F.col("size") - 2 * floor + 1)
    return _moved(ranked(record, "channel"), shift, draws, "channel")


def whole_cycle_clock_shift(record: DataFrame, draws: int, cycle: int, seed: int) -> DataFrame:
    """The same by whole cycles of ``cycle`` rows, so that the calendar stays in place.

    Refused where a record doesn't span more than one cycle: the shift would be by the whole record, or by nothing.
    """
    least = _least_size(record, "channel")
    if cycle < 1 or 0 < least <= cycle:
        raise Refused(f"a cycle of {cycle} rows isn't one that every record of {least} rows or more spans more than once")
    cycles = F.greatest(F.lit(1), F.floor(F.col("size") / cycle) - 1)
    return _moved(ranked(record, "channel"), cycle * (1 + drawn(F.lit(seed), F.col("draw"), F.col("channel")) % cycles), draws, "channel")


def within_group_clock_shift(record: DataFrame, draws: int, group: Column, seed: int) -> DataFrame:
    """The same within each group of rows; a group of one row stays.

    Refused where a channel is all one group: that would be the unrestricted shift under another name.
    """
    grouped = record.withColumn("group", group)
    _least_size(record, "channel")
    if not grouped.groupBy("channel").agg(F.countDistinct("group").alias("n")).where("n < 2").isEmpty():
        raise Refused("a channel is all one group")
    rows = ranked(grouped, "channel", "group")
    shift = F.when(F.col("size") > 1, 1 + drawn(F.lit(seed), F.col("draw"), F.col("channel"), F.col("group")) % F.greatest(F.lit(1), F.col("size") - 1)).otherwise(0)
    return _moved(rows, shift, draws, "channel", "group")


def block_bootstrap(record: DataFrame, draws: int, length: int, seed: int) -> DataFrame:
    """draw, channel, frame, value: runs of ``length`` rows, each from a place drawn for it, one after the other.

    Refused where a block isn't shorter than every record.
    """
    least = _least_size(record, "channel")
    if length < 1 or 0 < least <= length:
        raise Refused(f"a block of {length} rows isn't shorter than a record of {least}")
    rows = ranked(record, "channel")
    block = F.floor(F.col("at") / length)
    start = drawn(F.lit(seed), F.col("draw"), F.col("channel"), block) % F.greatest(F.lit(1), F.col("size") - length + 1)
    asked = rows.crossJoin(_draws(rows, draws)).select("draw", "channel", "frame", (start + F.col("at") % length).alias("at"))
    return asked.join(rows.select("channel", "at", "value"), ["channel", "at"]).select("draw", "channel", "frame", "value")


def global_value_shuffle(record: DataFrame) -> DataFrame:
    raise Refused("a shuffle of all values destroys the memory that the test must keep")


def pair_correlations(moved: DataFrame, record: DataFrame, lags: list[int]) -> DataFrame:
    """draw, driver, driven, lag, r: each moved channel with each other channel ``lag`` frames later."""
    lag = F.broadcast(record.sparkSession.createDataFrame([(k,) for k in lags], "lag long"))
    driver = moved.select("draw", F.col("channel").alias("driver"), "frame", F.col("value").alias("x")).crossJoin(lag).withColumn("frame", F.col("frame") + F.col("lag"))
    driven = record.select(F.col("channel").alias("driven"), "frame", F.col("value").alias("y"))
    return driver.join(driven, "frame").where("driver <> driven").groupBy("draw", "driver", "driven", "lag").agg(F.corr("x", "y").alias("r"))


def strongest(correlations: DataFrame) -> DataFrame:
    """draw, driver, driven, strength: the largest absolute correlation over the lags, to nine digits."""
    return correlations.groupBy("draw", "driver", "driven").agg(F.round(F.max(F.abs("r")), 9).alias("strength"))


def precedence_test(record: DataFrame, moved: DataFrame, lags: list[int]) -> DataFrame:
    """driver, driven, observed, n, reached, p_value of the strongest lag, and family_p against the largest of all pairs in a draw."""
    observed = strongest(pair_correlations(record.withColumn("draw", F.lit(0).cast("long")), record, lags)).select("driver", "driven", F.col("strength").alias("observed"))
    null = stored(strongest(pair_correlations(moved, record, lags)), "null-strengths")  # read for each pair and for the largest of a draw
    largest = null.groupBy("draw").agg(F.max("strength").alias("largest"))
    both = null.join(largest, "draw").join(observed, ["driver", "driven"])
    g = both.groupBy("driver", "driven", "observed").agg(F.count("*").alias("n"), F.count_if(F.col("strength") >= F.col("observed")).alias("reached"), F.count_if(F.col("largest") >= F.col("observed")).alias("reached_all"))
    return g.select("driver", "driven", "observed", "n", "reached", ((1 + F.col("reached")) / (1 + F.col("n"))).alias("p_value"), ((1 + F.col("reached_all")) / (1 + F.col("n"))).alias("family_p"))


def two_sided_p(draws: DataFrame, observed: Column, value: str, *keys: str) -> DataFrame:
    """keys, n, p_value: how many draws lie as far from their median as what was observed."""
    middle = draws.groupBy(*keys).agg(F.median(value).alias("middle"))
    g = draws.join(middle, list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.round(F.abs(F.col(value) - F.col("middle")), 9) >= F.round(F.abs(observed - F.col("middle")), 9)).alias("k"))
    return g.select(*keys, "n", ((1 + F.col("k")) / (1 + F.col("n"))).alias("p_value"))


def discrimination_curve(distances: DataFrame, radii: list[float]) -> DataFrame:
    """radius, false_split, admission: the share of pairs of one kind (``same``) beyond it, and of different kinds within it."""
    r = F.broadcast(distances.sparkSession.createDataFrame([(x,) for x in radii], "radius double"))
    same, within = F.col("same"), F.col("distance") <= F.col("radius")
    return distances.crossJoin(r).groupBy("radius").agg(F.avg(F.when(same, (~within).cast("double"))).alias("false_split"), F.avg(F.when(~same, within.cast("double"))).alias("admission"))


def recall_radius(distances: DataFrame, recall: float, *keys: str) -> DataFrame:
    """keys, n, radius: the smallest distance within which a share of ``recall`` of the pairs lies."""
    w = Window.partitionBy(*keys)
    at = distances.withColumn("i", F.row_number().over(w.orderBy("distance"))).withColumn("n", F.count("*").over(w))
    return at.where(F.col("i") == F.ceil(F.round(F.col("n") * recall, 9))).select(*keys, "n", F.col("distance").alias("radius"))
