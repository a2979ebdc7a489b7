"""Rules ranked, pairs and sets of declared axes, presence over scenes, and other small relational searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.errors import Refused

MOST_COMBINATIONS = 1000


def ranked_by_each(rules: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """``rules`` with rank_<key> for each key, best first within ``side``; rules without a figure come last, equals share a rank."""
    return rules.withColumns({f"rank_{k}": F.rank().over(Window.partitionBy(side).orderBy(F.col(k).desc_nulls_last())) for k in keys})


def directional_pairs(rules: DataFrame, figures: list[str]) -> DataFrame:
    """Both directions of each pair and window side by side: ``there`` and ``back`` figures."""
    there = rules.where("antecedent < consequent").select(F.col("antecedent").alias("a"), F.col("consequent").alias("b"), "lo", "hi", *[F.col(f).alias(f"{f}_there") for f in figures])
    back = rules.where("antecedent > consequent").select(F.col("consequent").alias("a"), F.col("antecedent").alias("b"), "lo", "hi", *[F.col(f).alias(f"{f}_back") for f in figures])
    return there.join(back, ["a", "b", "lo", "hi"], "full")


def best_of_pairs(candidates: DataFrame, strength: str, order: list[str], *pair: str) -> DataFrame:
    """One candidate for each pair: the strongest, then the first in the order. A link is one hypothesis, at whatever lags it shows."""
    first = F.min_by(F.struct(*candidates.columns), F.struct((-F.col(strength)).alias("s"), *order)).alias("c")
    return candidates.groupBy(*pair).agg(first).select("c.*")


def fisher_z(strength: Column) -> Column:
    return F.atanh(F.least(F.abs(strength), F.lit(0.999999)))


def indistinguishable(candidates: DataFrame, strength: str, n_effective: str) -> DataFrame:
    """Candidates within one standard error of the best one on Fisher's z scale: 1 / sqrt(n_effective - 3), of the best, n_effective being 4 at least.

    Of several that are best, the one with the most effective pairs sets the error.
    """
    best = candidates.groupBy().agg(F.max(F.struct(F.col(strength).alias("strength"), F.col(n_effective).alias("n"))).alias("b"))
    error = 1 / F.sqrt(F.greatest(F.lit(4.0), F.col("b.n")) - 3)
    return candidates.crossJoin(F.broadcast(best)).where(fisher_z(F.col("b.strength")) - fisher_z(F.col(strength)) <= error).drop("b")


def chosen(candidates: DataFrame, order: list[Column], cap: int, *keys: str) -> DataFrame:
    """The first ``cap`` candidates within the keys."""
    return candidates.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= cap).drop("_i")


def records_by_overlap(records: DataFrame, text: str, words: list[str], key: str, primary: int, most: int = 8) -> DataFrame:
    """key, score: the records that share most words with the query, ties by key; the primary one first, whatever its score."""
    own = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"))
    score = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words])))
    return records.select(key, score.cast("long").alias("score")).orderBy((F.col(key) == primary).desc(), F.desc("score"), key).limit(most)


def latest(rows: DataFrame, value: str, order: list[str], *keys: str) -> DataFrame:
    """keys, value of the row that comes last in the order."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def overlapping(anchors: DataFrame, span: int, *keys: str) -> DataFrame:
    """keys, n, overlapping: anchors whose window of ``span`` frames begins within that of the one before."""
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy(*keys).orderBy("frame"))
    return anchors.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("gap") < span).alias("overlapping"))


def presence(seen: DataFrame, key: str, scene: str, scenes: int) -> DataFrame:
    """present, configurations: how many configurations were present in so many scenes, from 0 to all of them."""
    counts = seen.groupBy(key).agg(F.countDistinct(scene).alias("present")).groupBy("present").agg(F.count("*").alias("configurations"))
    return seen.sparkSession.range(0, scenes + 1).select(F.col("id").alias("present")).join(counts, "present", "left").fillna(0, ["configurations"])


def admission_rates(distribution: DataFrame, scenes: int, absences: list[int]) -> DataFrame:
    """absences, rate: the share of configurations that are missing from so many scenes at most."""
    a = F.broadcast(distribution.sparkSession.createDataFrame([(k,) for k in absences], "absences long"))
    return distribution.crossJoin(a).groupBy("absences").agg((F.sum(F.when(F.col("present") >= scenes - F.col("absences"), F.col("configurations")).otherwise(0)) / F.sum("configurations")).alias("rate"))


def verdict_travel(values: DataFrame, value: str, old: float, new: float, *keys: str) -> DataFrame:
    """keys, n, gained and lost: values that pass only the new bar, or only the old one."""
    a, b = F.col(value) >= old, F.col(value) >= new
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(b & ~a).alias("gained"), F.count_if(a & ~b).alias("lost"))


def spread(pool: DataFrame, value: str, observed: Column, *keys: str) -> DataFrame:
    """keys, n, low, middle, high, percentile: a pool's range and the share of it at or under what was observed."""
    return pool.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.median(value).alias("middle"), F.max(value).alias("high"), F.avg((F.col(value) <= observed).cast("double")).alias("percentile"))


def nearest_summary(rows: DataFrame, value: str, radius: float, *keys: str) -> DataFrame:
    """keys, n, low, upper_median (no value is made up between two), high, inside, majority."""
    w = Window.partitionBy(*keys)
    at = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return at.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(value))).alias("upper_median"), F.max(value).alias("high"), F.count_if(F.col(value) <= radius).alias("inside"), (F.floor(F.count("*") / 2) + 1).alias("majority"))


def parameter_grid(*axes: DataFrame) -> DataFrame:
    """All combinations of the axes' values; more than MOST_COMBINATIONS are refused before any is made."""
    n = reduce(lambda a, b: a * b, [axis.count() for axis in axes], 1)
    if n > MOST_COMBINATIONS:
        raise Refused(f"{n} combinations; at most {MOST_COMBINATIONS} may be declared")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def axis_pairs(axis: DataFrame, value: str, ordered: bool) -> DataFrame:
    """first, second: pairs of different values of a declared axis."""
    a, b = F.broadcast(axis.select(F.col(value).alias("first"))), axis.select(F.col(value).alias("second"))
    return b.join(a, F.col("first") != F.col("second") if ordered else F.col("first") < F.col("second")).select("first", "second")


def label_sets(labels: DataFrame, value: str, arities: list[int]) -> DataFrame:
    """arity, labels: all sets of so many labels, in order, joined by +."""
    out, sets = [], labels.select(F.col(value).alias("last"), F.col(value).alias("labels"))
    for k in range(1, max(arities) + 1):
        if k > 1:
            sets = sets.join(F.broadcast(labels.select(F.col(value).alias("next"))), F.col("next") > F.col("last")).select(F.col("next").alias("last"), F.concat_ws("+", "labels", "next").alias("labels"))
        if k in arities:
            out.append(sets.select(F.lit(k).cast("long").alias("arity"), "labels"))
    return reduce(DataFrame.unionByName, out)


def cross_domain_pairs(channels: DataFrame) -> DataFrame:
    """driver_domain, driver, driven_domain, driven: ordered pairs of channels (domain, channel) of different domains only."""
    a, b = channels.select(F.col("domain").alias("driver_domain"), F.col("channel").alias("driver")), channels.select(F.col("domain").alias("driven_domain"), F.col("channel").alias("driven"))
    return b.join(F.broadcast(a), F.col("driver_domain") != F.col("driven_domain")).select("driver_domain", "driver", "driven_domain", "driven")


def coverage(planted: DataFrame, recovered: DataFrame, *keys: str) -> DataFrame:
    """keys, status: recovered, missed or unplanted."""
    both = planted.select(*keys, F.lit(1).alias("p")).distinct().join(recovered.select(*keys, F.lit(1).alias("r")).distinct(), list(keys), "full")
    return both.select(*keys, F.when(F.col("p").isNull(), "unplanted").when(F.col("r").isNull(), "missed").otherwise("recovered").alias("status"))


def merged(parts: list[DataFrame], *keys: str) -> DataFrame:
    """The union of the parts; a key in two of them is refused."""
    out = reduce(DataFrame.unionByName, parts)
    if not out.groupBy(*keys).count().where("count > 1").isEmpty():
        raise Refused(f"the parts share values of {', '.join(keys)}")
    return out


def flattened(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, path, value: the members of a JSON object, one level deep, as text."""
    members = F.explode(F.from_json(column, "map<string, string>")).alias("path", "value")
    return rows.select(*keys, members)
