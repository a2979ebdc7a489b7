"""Records about analyses: hash chains, journals, claim ladders, one-use ledgers, screening, search, wording guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.errors import Refused

RUNGS = ("observation", "association", "robust", "precursor", "predictive")
# fixed values: terms that claim more than an association
CAUSAL = ("because", "cause", "caused", "causes", "causing", "due to", "drives", "driven by", "leads to", "therefore")


def entry_hash(previous: Column, *content: Column) -> Column:
    """SHA-256 of the entry before and this one's content, joined by |."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), *[F.coalesce(c.cast("string"), F.lit("")) for c in content]), 256)


def chained(rows: DataFrame, content: Sequence[str], *keys: str, order: str = "seq") -> DataFrame:
    """``rows`` with content_sha256 and previous_sha256, the content hash of the row before in each key's order."""
    own = rows.withColumn("content_sha256", entry_hash(F.lit(""), *[F.col(c) for c in content]))
    return own.withColumn("previous_sha256", F.lag("content_sha256").over(Window.partitionBy(*keys).orderBy(order)))


def verified_chains(rows: DataFrame, content: Sequence[str], *keys: str, order: str = "seq") -> DataFrame:
    """keys, entries, intact: whether stored hashes are those of the content and of the entry before."""
    own = entry_hash(F.lit(""), *[F.col(c) for c in content])
    before = F.lag("content_sha256").over(Window.partitionBy(*keys).orderBy(order))
    checked = rows.withColumn("_ok", (F.col("content_sha256") == own) & F.col("previous_sha256").eqNullSafe(before))
    return checked.groupBy(*keys).agg(F.count("*").alias("entries"), F.bool_and("_ok").alias("intact"))


def folded(journal: DataFrame, *keys: str) -> DataFrame:
    """keys, state, steps, last_outcome: a journal (seq, kind, detail) read to its end.

    The state is the last transition's detail; steps counts the kind step alone; the outcome is the last step's, reused or not.
    """
    last = lambda *kinds: F.max_by("detail", F.when(F.col("kind").isin(*kinds), F.col("seq")))
    return journal.groupBy(*keys).agg(last("transition").alias("state"), F.count_if(F.col("kind") == "step").alias("steps"), last("step", "step_reused").alias("last_outcome"))


def claim_ladder(evidence: DataFrame, *keys: str) -> DataFrame:
    """keys, rung: the highest rung whose gates, and all below it, have passed; a failure or contradiction caps at the first.

    evidence: keys, category, status. Gates: observation; observations, effect_sizes, uncertainty; replication_results,
    confounders; provenance, temporal_precedence; holdout_performance.
    """
    passed = lambda c: F.bool_or((F.col("category") == c) & (F.col("status") == "PASS"))
    gates = [("observations", "effect_sizes", "uncertainty"), ("replication_results", "confounders"), ("provenance", "temporal_precedence"), ("holdout_performance",)]
    each = [passed(c).alias(c) for g in gates for c in g]
    clean = F.bool_and(~F.col("status").isin("FAIL", "INVALID") & ~((F.col("category") == "contradictions") & (F.col("status") == "PASS")))
    g = evidence.groupBy(*keys).agg(clean.alias("clean"), *each)
    up, rung = F.col("clean"), F.lit(0)
    for names in gates:
        for c in names:
            up = up & F.col(c)
        rung = rung + up.cast("int")
    return g.select(*keys, F.element_at(F.array(*[F.lit(r) for r in RUNGS]), rung + 1).alias("rung"))


def one_use(openings: DataFrame, key: str = "partition") -> DataFrame:
    """Each key's first opener, by time and then name; later ones don't count."""
    w = Window.partitionBy(key).orderBy("opened", "opener")
    return openings.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def guard_unopened(ledger: DataFrame, partition: str) -> None:
    """Refuses a partition that the ledger has."""
    if not ledger.where(F.col("partition") == partition).isEmpty():
        raise Refused(f"{partition} has been opened before")


def searched(rows: DataFrame, query: str, most: int, *, id_col: str, text: str, primary=None) -> DataFrame:
    """id, score of the rows that share most words with the query, ties by id; a primary row comes first whatever its score."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"))
    asked = F.array(*[F.lit(w) for w in sorted({w for w in query.lower().split() if w})])
    scored = rows.select(F.col(id_col).alias("id"), F.size(F.array_intersect(words, asked)).alias("score"))
    first = F.col("id") == F.lit(primary) if primary is not None else F.lit(False)
    return scored.where((F.col("score") > 0) | first).orderBy(first.desc(), F.desc("score"), "id").limit(most)


def wording(rows: DataFrame, text: Column, terms: Sequence[str] = CAUSAL) -> DataFrame:
    """``rows`` with the number of forbidden terms that the text holds as whole words."""
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(terms) + r")(?![\p{L}\p{N}])"
    return rows.withColumn("terms", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)))


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """Rows offset + 1 to offset + limit in the given order; limits are 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise Refused("a page has 1 to 200 rows and starts at 0 or later")
    return rows.orderBy(*order).offset(offset).limit(limit)


def screen_correlations(runs: DataFrame, parameters: Sequence[str], metrics: Sequence[str], *keys: str) -> DataFrame:
    """keys, parameter, metric, n, r of every numeric parameter that takes more than one value."""
    pairs = [F.struct(F.lit(p).alias("parameter"), F.lit(m).alias("metric"), F.col(p).cast("double").alias("x"), F.col(m).cast("double").alias("y")) for p in parameters for m in metrics]
    long = runs.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    g = long.groupBy(*keys, "parameter", "metric").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.min("x").alias("a"), F.max("x").alias("b"))
    return g.where("b > a").drop("a", "b")


def screen_groups(runs: DataFrame, parameter: str, metric: str, *keys: str) -> DataFrame:
    """keys, groups, n, f of a one-way analysis of variance over the parameter's groups of two rows or more."""
    each = runs.where(F.col(parameter).isNotNull() & F.col(metric).isNotNull()).groupBy(*keys, parameter).agg(F.count("*").alias("k"), F.avg(metric).alias("m"), F.var_pop(metric).alias("v")).where("k >= 2")
    k, m = F.col("k"), F.col("m")
    g = each.groupBy(*keys).agg(F.count("*").alias("groups"), F.sum("k").alias("n"), F.sum(k * m).alias("s"), F.sum(k * m * m).alias("q"), F.sum(k * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = (between / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return g.select(*keys, "groups", "n", F.when((F.col("groups") > 1) & (F.col("within") > 0), f).alias("f"))


def replicated(first: DataFrame, second: DataFrame, *label: str, alpha: float = 0.05) -> DataFrame:
    """Labels significant, with positive excess, in both halves (columns q, excess)."""
    good = (F.col("q") <= alpha) & (F.col("excess") > 0)
    return first.where(good).select(*label).join(second.where(good).select(*label), list(label)).distinct()


def family_size(spark, *axes: int) -> int:
    """The size of a product of declared axes, priced without building it."""
    out = 1
    for n in axes:
        out *= n
    return out
