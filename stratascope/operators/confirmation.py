"""Searches over lagged pairs that end in a confirmation: swept on a first stretch of a record, frozen, tested once on a later one.

A member of the family is an ordered pair of channels at a lag, named driver>driven@lag. The sweep proposes; a seal freezes
what it can't tell apart from the best and the ensemble can afford; the confirmation tests those labels at their frozen lags
on the held-out stretch, against circular shifts of the driver, and corrects over the frozen size. Channels may belong to
domains on one clock: then only pairs across domains are swept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators import clocks, sealing, search
from stratascope.operators.nulls import circular_clock_shift
from stratascope.operators.testing import check_power


def stretches(record: DataFrame, share: float, embargo: int) -> tuple[DataFrame, DataFrame]:
    """The record's first ``share`` of frames, and what lies ``embargo`` frames or more behind it; frames of the latter from 0.

    Refused where the embargo is shorter than the record's memory, the widest lag and memory being what ties both together.
    """
    low, high = record.agg(F.min("frame"), F.max("frame")).first()
    if low is None or not 0 < share < 1:
        raise Refused("a record and a share between 0 and 1 are needed")
    cut = low + int((high - low + 1) * share)
    if cut + embargo > high:
        raise Refused("nothing is left behind the embargo")
    return record.where(F.col("frame") < cut), record.where(F.col("frame") >= cut + embargo).withColumn("frame", F.col("frame") - (cut + embargo))


def label(driver: Column, driven: Column, lag: Column) -> Column:
    return F.concat(driver, F.lit(">"), driven, F.lit("@"), lag.cast("string"))


def sweep(record: DataFrame, lags: list[int], domain: Column | None = None) -> DataFrame:
    """label, driver, driven, lag, strength, n_effective of every ordered pair at every lag; across domains only, if channels have them.

    ``domain`` is an expression of the column ``channel``.
    """
    r1 = clocks.lag_one(record, "channel")
    own = r1.select("channel", "r1", (domain if domain is not None else F.lit(None).cast("string")).alias("domain"))
    side = lambda name: F.broadcast(own.select(F.col("channel").alias(name), F.col("r1").alias(f"r_{name}"), F.col("domain").alias(f"d_{name}"))) if r1.count() <= 100_000 else own.select(F.col("channel").alias(name), F.col("r1").alias(f"r_{name}"), F.col("domain").alias(f"d_{name}"))
    found = clocks.lagged_correlations(record, lags).where("r IS NOT NULL").join(side("driver"), "driver").join(side("driven"), "driven")
    if domain is not None:
        found = found.where("d_driver <> d_driven")
    product = F.least(F.greatest(F.col("r_driver") * F.col("r_driven"), F.lit(-0.999)), F.lit(0.999))
    effective = F.greatest(F.lit(3.0), F.col("n") * (1 - product) / (1 + product))
    return found.select(label(F.col("driver"), F.col("driven"), F.col("lag")).alias("label"), "driver", "driven", "lag", F.round(F.abs("r"), 9).alias("strength"), effective.alias("n_effective"))


def affordable(draws: int, alpha: float = 0.05, method: str = "by") -> int:
    """The largest family of which these draws could still reject one."""
    if not check_power(draws, 1, alpha, method):
        raise Refused(f"{draws} draws can't reject a single test")
    low, high = 1, 2
    while check_power(draws, high, alpha, method):
        low, high = high, 2 * high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if check_power(draws, middle, alpha, method) else (low, middle)
    return low


def proposed(swept: DataFrame, draws: int, alpha: float = 0.05, method: str = "by") -> DataFrame:
    """One lag a pair, those that the sweep can't tell apart from the best, the strongest first, as many as the draws can afford."""
    best = search.best_of_pairs(swept, "strength", ["lag"], "driver", "driven")
    return search.indistinguishable(best, "strength", "n_effective").orderBy(F.desc("strength"), "label").limit(affordable(draws, alpha, method))


def evidence(frozen: DataFrame, record: DataFrame, draws: int, floor: int, seed: int) -> DataFrame:
    """label, strength, reached, p_value: each frozen pair at its frozen lag, and in how many draws the shifted driver does as well.

    ``frozen`` is short: label, driver, driven, lag. Shifts keep ``floor`` frames from either end.
    """
    pairs = F.broadcast(frozen.select("label", "driver", "driven", "lag"))
    driven = record.select(F.col("channel").alias("driven"), "frame", F.col("value").alias("y")).where("y IS NOT NULL")

    def strengths(drivers: DataFrame) -> DataFrame:
        x = drivers.where("value IS NOT NULL").select("draw", F.col("channel").alias("driver"), "frame", F.col("value").alias("x")).join(pairs, "driver").withColumn("frame", F.col("frame") + F.col("lag"))
        return x.join(driven, ["driven", "frame"]).groupBy("draw", "label").agg(F.round(F.abs(F.corr("x", "y")), 9).alias("strength"))

    observed = strengths(record.withColumn("draw", F.lit(0).cast("long"))).select("label", F.col("strength").alias("own"))
    null = strengths(circular_clock_shift(record, draws, floor, seed)).join(F.broadcast(observed), "label")
    g = null.groupBy("label", "own").agg(F.count("*").alias("n"), F.count_if(F.col("strength") >= F.col("own")).alias("reached"))
    return g.select("label", F.col("own").alias("strength"), "reached", ((1 + F.col("reached")) / (1 + F.col("n"))).alias("p_value"))


def confirmed(record: DataFrame, held_out: DataFrame, lags: list[int], *, draws: int, floor: int, seed: int, ledger: sealing.Ledger, sealed_at: str, opened_at: str, domain: Column | None = None, alpha: float = 0.05, method: str = "by", study: str = "") -> tuple[sealing.Seal, DataFrame]:
    """The seal, and label, strength, reached, p_value, q, confirmed of what was frozen. The held-out stretch is spent."""
    swept = sweep(record, lags, domain)
    picked = proposed(swept, draws, alpha, method)
    identity = sealing.partition_digest(held_out, "channel", "frame", "value")
    seal = sealing.freeze(swept, picked, identity, draws=draws, sealed_at=sealed_at, alpha=alpha, method=method, study=study, ledger=ledger)
    return seal, sealing.confirm(seal, evidence(picked, held_out, draws, floor, seed), identity, ledger, opened_at)
