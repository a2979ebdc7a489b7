"""Information and dependence between channels: quantile codes, entropies, mutual information, transfer entropy.

Codes are the number of interior quantile edges at or below a value; entropies are in nats with the Miller-Madow term.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import stored


def quantiles(record: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """The exact linear quantiles of a whole column, nulls aside; None without values.

    Values are counted, and the counts dealt out in order of their values. What comes to the driver is a row a part; only the
    parts that hold a wanted place are then read again, so that no task ever holds all values.
    """
    of = record.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("k"))
    counts = stored(of.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = sorted(counts.groupBy("part").agg(F.min("v").alias("low"), F.sum("k").alias("k")).collect(), key=lambda r: (r["low"] != r["low"], r["low"]))
    n, begins = 0, {}
    for r in parts:
        begins[r["part"]] = (n, n := n + r["k"])
    if not n:
        return None
    at = [(n - 1) * q for q in shares]
    wanted = sorted({place for x in at for place in (math.floor(x), math.ceil(x))})
    held = {place: part for part, (low, high) in begins.items() for place in wanted if low <= place < high}
    upto = F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    within = counts.where(F.col("part").isin(list(set(held.values())))).withColumn("upto", upto)
    some = within.agg(*[F.min(F.when((F.col("part") == part) & (F.col("upto") > place - begins[part][0]), F.col("v"))).alias(f"p{place}") for place, part in held.items()]).first()
    out = []
    for x in at:
        low, high = math.floor(x), math.ceil(x)
        a, b = some[f"p{low}"], some[f"p{high}"]
        out.append(a if low == high or a == b else (high - x) * a + (x - low) * b)
    return out


def quantile_codes(record: DataFrame, bins: int, *keys: str, value: str = "value", code: str = "code") -> DataFrame:
    """``record`` with the code of each value among its key's linear quantiles; ties merge bins. Keys' records are short."""
    inner = [j / bins for j in range(1, bins)]
    if not keys:
        edges = quantiles(record, value, inner)
        return record.withColumn(code, F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda n, e: n + F.when(e <= F.col(value), 1).otherwise(0)) if edges else F.lit(None).cast("int"))
    edges = record.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in inner])).alias("_edges"))
    joined = record.join(edges, list(keys))
    return joined.withColumn(code, F.aggregate("_edges", F.lit(0), lambda n, e: n + F.when(e <= F.col(value), 1).otherwise(0))).drop("_edges")


def joint_counts(codes: DataFrame, groups: list[str], *cells: str) -> DataFrame:
    """groups, cells, k: how often each joint cell occurs; what the entropies of any of its parts come from."""
    return codes.groupBy(*groups, *cells).agg(F.count("*").alias("k"))


def entropy(joint: DataFrame, groups: list[str], *cells: str) -> DataFrame:
    """groups, n, h: entropy over the cells within each group, from joint counts."""
    each = joint.groupBy(*groups, *cells).agg(F.sum("k").alias("k"))
    n = each.groupBy(*groups).agg(F.sum("k").alias("n"), F.count("*").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
    # -sum p ln p = ln n - sum k ln k / n
    return n.select(*groups, "n", (F.log("n") - F.col("s") / F.col("n") + (F.col("m") - 1) / (2 * F.col("n"))).alias("h"))


def _together(parts: list[DataFrame], groups: list[str], names: list[str]) -> DataFrame:
    out = parts[0].withColumnRenamed("h", names[0])
    for part, name in zip(parts[1:], names[1:]):
        out = out.join(part.select(*groups, F.col("h").alias(name)), groups)
    return out


def mutual_information(codes: DataFrame, groups: list[str], x: str = "x", y: str = "y", floored: bool = True) -> DataFrame:
    """groups, n, mi = H(x) + H(y) - H(x, y), no less than 0 if floored."""
    joint = joint_counts(codes, groups, x, y)
    h = _together([entropy(joint, groups, x), entropy(joint, groups, y), entropy(joint, groups, x, y)], groups, ["hx", "hy", "hxy"])
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return h.select(*groups, "n", (F.greatest(F.lit(0.0), mi) if floored else mi).alias("mi"))


def conditional_information(codes: DataFrame, groups: list[str], x: str, y: str, z: str) -> DataFrame:
    """groups, n, cmi = H(x, z) + H(y, z) - H(z) - H(x, y, z)."""
    joint = joint_counts(codes, groups, x, y, z)
    h = _together([entropy(joint, groups, x, z), entropy(joint, groups, y, z), entropy(joint, groups, z), entropy(joint, groups, x, y, z)], groups, ["a", "b", "c", "d"])
    return h.select(*groups, "n", (F.col("a") + F.col("b") - F.col("c") - F.col("d")).alias("cmi"))


def lagged_codes(codes: DataFrame, lags: list[int], length: int, wrap: bool = True) -> DataFrame:
    """source, target, lag, x (source now), past and future of the target; frames are 0 .. length - 1."""
    lag = F.broadcast(codes.sparkSession.createDataFrame([(k,) for k in lags], "lag long"))
    target = codes.select(F.col("channel").alias("target"), "frame", F.col("code").alias("past"))
    ahead = F.col("frame") - F.col("lag")
    future = codes.select(F.col("channel").alias("target"), "frame", F.col("code").alias("future")).crossJoin(lag)
    future = future.withColumn("frame", F.pmod(ahead, F.lit(length)) if wrap else ahead)
    source = codes.select(F.col("channel").alias("source"), "frame", F.col("code").alias("x"))
    return target.join(future, ["target", "frame"]).join(source, "frame").where("source <> target")


def transfer_entropy(codes: DataFrame, lags: list[int], length: int, wrap: bool = True) -> DataFrame:
    """source, target, lag, n, te = I(future; source | past), no less than 0, for lags of 1 and more."""
    rows = lagged_codes(codes, [k for k in lags if k >= 1], length, wrap)
    return conditional_information(rows, ["source", "target", "lag"], "future", "x", "past").withColumn("te", F.greatest(F.lit(0.0), "cmi")).drop("cmi")


def lagged_information(codes: DataFrame, lags: list[int], length: int, wrap: bool = True) -> DataFrame:
    """source, target, lag, n, mi between the source now and the target lag frames later."""
    return mutual_information(lagged_codes(codes, lags, length, wrap), ["source", "target", "lag"], "x", "future")


def pair_structure(codes: DataFrame, features: list[str], target: str) -> DataFrame:
    """a, b, mi_a, mi_b, mi_ab, interaction = mi_a + mi_b - mi_ab for each pair of coded features; nothing is floored."""
    pairs = [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(p).alias("x"), F.col(q).alias("y")) for i, p in enumerate(features) for q in features[i + 1 :]]
    rows = codes.select(F.col(target).alias("t"), F.explode(F.array(*pairs)).alias("p")).select("t", "p.*")
    g = ["a", "b"]
    joint = joint_counts(rows, g, "x", "y", "t")
    h = _together([entropy(joint, g, *c) for c in (("x",), ("y",), ("t",), ("x", "t"), ("y", "t"), ("x", "y"), ("x", "y", "t"))], g, ["hx", "hy", "ht", "hxt", "hyt", "hxy", "hxyt"])
    a, b, ab = F.col("hx") + F.col("ht") - F.col("hxt"), F.col("hy") + F.col("ht") - F.col("hyt"), F.col("hxy") + F.col("ht") - F.col("hxyt")
    return h.select("a", "b", "n", a.alias("mi_a"), b.alias("mi_b"), ab.alias("mi_ab"), (a + b - ab).alias("interaction"))


def conditional_support(codes: DataFrame, stratum: Column, x: str, y: str, least: int) -> DataFrame:
    """stratum, n, x_levels, y_levels, cells, admitted: whether a stratum holds enough rows, levels and rows a cell."""
    each = codes.withColumn("stratum", stratum).groupBy("stratum").agg(F.count("*").alias("n"), F.countDistinct(x).alias("x_levels"), F.countDistinct(y).alias("y_levels"), F.countDistinct(x, y).alias("cells"))
    return each.withColumn("admitted", (F.col("n") >= least * F.col("cells")) & (F.col("x_levels") >= 2) & (F.col("y_levels") >= 2))


def admissible_shifts(spark, length: int, lag: int, clear: int) -> DataFrame:
    """The circular shifts at a distance of ``clear`` or more from 0 and from -lag."""
    s = F.col("id")
    far = lambda d: F.least(F.pmod(d, F.lit(length)), length - F.pmod(d, F.lit(length))) >= clear
    return spark.range(1, length).where(far(s) & far(s + lag)).select(s.alias("shift"))


def shifted_information(codes: DataFrame, lag: int, length: int, clear: int) -> DataFrame:
    """source, target, shift, mi between each shifted source and each other target, for every admissible shift.

    ``codes`` has channel, frame and code. How often two codes meet at every shift is a circular correlation of where they
    stand; a row a pair of channels holds their codes, a number a frame, and missing frames meet nothing.
    """
    whole = codes.groupBy("channel").agg(F.collect_list(F.struct(F.col("frame").cast("int").alias("frame"), "code")).alias("at"))
    pairs = whole.select(F.col("channel").alias("source"), F.col("at").alias("a")).join(whole.select(F.col("channel").alias("target"), F.col("at").alias("b")), F.col("source") != F.col("target"))

    def planes(at) -> np.ndarray:
        frames, own = np.array([r["frame"] for r in at], int) % length, np.array([r["code"] for r in at], int)
        out = np.zeros((own.max(initial=0) + 1, length))
        out[own, frames] = 1
        return np.fft.rfft(out, axis=1)

    def entropy_of(k: np.ndarray) -> np.ndarray:
        n = k.sum(axis=0)
        with np.errstate(all="ignore"):
            return np.log(n) - np.where(k > 0, k * np.log(k), 0).sum(axis=0) / n + ((k > 0).sum(axis=0) - 1) / (2 * n)

    def shift(batches):
        s = np.arange(1, length)
        far = lambda d: np.minimum(d % length, (-d) % length) >= clear
        use = s[far(s) & far(s + lag)]
        for rows in batches:
            for r in rows.itertuples():
                x, y = planes(r.a), planes(r.b)
                both = np.rint(np.fft.irfft(np.conj(x)[:, None] * y[None], length, axis=2))[:, :, (use + lag) % length]
                mi = entropy_of(both.sum(axis=1)) + entropy_of(both.sum(axis=0)) - entropy_of(both.reshape(-1, len(use)))
                yield pd.DataFrame({"source": r.source, "target": r.target, "shift": use, "mi": np.maximum(mi, 0.0)})

    kind = codes.schema["channel"].dataType.simpleString()
    return pairs.mapInPandas(shift, f"source {kind}, target {kind}, shift long, mi double")
