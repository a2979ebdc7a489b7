"""Queries over null calibration, tails, cliques and pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import stored
from stratascope.operators import calibration
from stratascope.operators.clocks import seconds
from stratascope.operators.nulls import drawn
from stratascope.plans import recasts as r
from stratascope.plans.null_queries import draw_sql
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
MEMBERS, SEED = 19, 23
RADII = [60.0, 300.0, 900.0, 1800.0, 3600.0, 7200.0, 14400.0, 43200.0, 86400.0, 172800.0]

GAPS_SQL = f"""tm AS (SELECT event_id, user_id, {r.SECONDS.format('ts')} AS s FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), sp AS (SELECT min(s) AS lo, max(s) - min(s) + 1 AS n FROM tm),
mv AS (SELECT 0 AS member, user_id, s FROM tm UNION ALL SELECT k, user_id, lo + {draw_sql(str(SEED), 'k', 'event_id')} % n FROM tm, sp, range(1, {MEMBERS + 1}) t(k)),
gp AS (SELECT member, (s - lag(s) OVER (PARTITION BY member, user_id ORDER BY s))::DOUBLE AS distance FROM mv),
fr AS (SELECT member, radius, (count(*) FILTER (distance <= radius))::DOUBLE / count(*) AS fraction FROM gp, (SELECT unnest({RADII})::DOUBLE AS radius) WHERE distance IS NOT NULL GROUP BY 1, 2),
cv AS (SELECT f.radius, o.fraction AS observed, avg(f.fraction) AS null_mean, count(*) FILTER (f.fraction >= o.fraction) AS k, count(*) AS n FROM fr f JOIN fr o ON o.member = 0 AND f.member > 0 AND f.radius = o.radius GROUP BY 1, 2)"""


def gaps(spark, d):
    """(member, distance): seconds between a user's events, as they are (member 0) and with hashed times within the record."""
    e = r.read(spark, d, "events").where("ts IS NOT NULL AND user_id IS NOT NULL").select("event_id", "user_id", seconds(F.col("ts")).alias("s"))
    span = e.agg(F.min("s").alias("lo"), (F.max("s") - F.min("s") + 1).alias("n"))
    null = e.crossJoin(F.broadcast(span)).withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(MEMBERS))))
    moved = null.select("member", "user_id", (F.col("lo") + drawn(F.lit(SEED), F.col("member"), F.col("event_id")) % F.col("n")).alias("s"))
    every = e.select(F.lit(0).alias("member"), "user_id", "s").unionByName(moved)
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("member", "user_id").orderBy("s"))
    return every.select("member", gap.cast("double").alias("distance"))


def _fractions(spark, d):
    return stored(calibration.member_fractions(gaps(spark, d), RADII), "fractions")


@queries.add("excess_curve", f"WITH {GAPS_SQL} SELECT radius, {sql_round('observed')}, {sql_round('null_mean')}, {sql_round('observed - null_mean', 'excess')}, {sql_round('(1 + k) / (1 + n)', 'p_value')} FROM cv")
def excess_curve(spark, d):
    return rounded(calibration.excess_curve(_fractions(spark, d)), "observed", "null_mean", "excess", "p_value")


SEPARATION_SQL = f"""{GAPS_SQL}, ex AS (SELECT member, radius, fraction - CASE WHEN member = 0 THEN sum(fraction) FILTER (member > 0) OVER w / {MEMBERS} ELSE (sum(fraction) FILTER (member > 0) OVER w - fraction) / ({MEMBERS} - 1) END AS e FROM fr WINDOW w AS (PARTITION BY radius)),
bs AS (SELECT member, max(e) AS s, arg_min(radius, struct_pack(a := -e, b := radius)) AS radius FROM ex GROUP BY 1),
cr AS (SELECT s AS critical FROM (SELECT s, row_number() OVER (ORDER BY s) AS i FROM bs WHERE member > 0) WHERE i = ceil(round(0.95::DOUBLE * ({MEMBERS} - 1), 9)) + 1),
sp2 AS (SELECT o.s AS statistic, o.radius, (1 + (SELECT count(*) FROM bs WHERE member > 0 AND bs.s >= o.s)) / (1.0::DOUBLE + {MEMBERS}) AS p FROM bs o WHERE member = 0)"""


@queries.add("separation_test", f"WITH {SEPARATION_SQL} SELECT {sql_round('statistic')}, radius, {sql_round('p', 'p_value')}, {sql_round('critical')}, p <= 0.05 AS significant, {MEMBERS}::BIGINT AS members, ceil({len(RADII)} * (SELECT sum(1::DOUBLE / i) FROM range(1, {len(RADII) + 1}) t(i)) / 0.05::DOUBLE - 1e-9)::BIGINT - 1 AS swept FROM sp2, cr")
def separation_test(spark, d):
    return rounded(calibration.separation(_fractions(spark, d)), "statistic", "p_value", "critical")


@queries.add("recurrence_fraction", f"WITH {SEPARATION_SQL}, v AS (SELECT CASE WHEN observed - null_mean > critical AND null_mean <= 0.25 THEN (observed - null_mean) / (1 - null_mean) END AS v, observed - null_mean AS e FROM cv, cr) SELECT {sql_round('coalesce(median(v), max(e))', 'fraction')}, count(v) AS read_at, {sql_round('coalesce(max(v) - min(v), 0)', 'spread')}, coalesce(count(v) >= 2 AND max(v) - min(v) <= 0.05, false) AS stable FROM v")
def recurrence_fraction(spark, d):
    f = _fractions(spark, d)
    critical = calibration.separation(f).first()["critical"]
    out = calibration.recurrence(calibration.excess_curve(f), critical)
    return rounded(out.withColumn("stable", F.coalesce("stable", F.lit(False))), "fraction", "spread")


@queries.add("tail_probabilities")
def tail_probabilities(spark, d):
    """How rare each gap between a user's events is, under a tail fitted to the gaps of the first null member."""
    g = stored(gaps(spark, d).where("member <= 1 AND distance IS NOT NULL"), "gaps")
    tail = calibration.lower_tail(g.where("member = 1"))
    p = calibration.tail_probability(F.col("distance"), tail)
    return rounded(g.where("member = 0").groupBy("distance").agg(F.count("*").alias("n")).select("distance", "n", p.alias("probability")), "probability", digits=4)


@queries.add("clique_expectations", f"""WITH mt AS (SELECT l_orderkey % 97 AS block, count(DISTINCT l_linenumber) AS scenes, greatest(1, count(DISTINCT l_partkey)) AS configurations, count(*) AS edges FROM lineitem GROUP BY 1),
z AS (SELECT *, unnest(range(2, scenes + 1)) AS size FROM mt WHERE scenes >= 2), q AS (SELECT *, (factorial(scenes::INT) / (factorial(size::INT) * factorial((scenes - size)::INT)))::DOUBLE * configurations::DOUBLE ** size AS sets, (size * (size - 1) // 2) AS pairs, edges / (scenes * (scenes - 1) / 2 * configurations::DOUBLE * configurations) AS p FROM z)
SELECT block, scenes, configurations, edges, size::INT AS size, pairs, {sql_round('log10(sets)', 'log_sets')}, {sql_round('log10(sets * p ** pairs)', 'log_expected')} FROM q""")
def clique_expectations(spark, d):
    """Blocks of orders as matchings: line numbers as scenes, parts as configurations, lines as edges."""
    g = r.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("block")).agg(F.countDistinct("l_linenumber").alias("scenes"), F.countDistinct("l_partkey").alias("configurations"), F.count("*").alias("edges"))
    out = calibration.expected_cliques(g.where("scenes >= 2"))
    return rounded(out.select("block", "scenes", "configurations", "edges", "size", "pairs", F.log10("sets").alias("log_sets"), F.log10("expected").alias("log_expected")), "log_sets", "log_expected")


POOLS_SQL = "nt AS (SELECT c_nationkey AS nation, count(*) AS tests FROM customer GROUP BY 1), h AS (SELECT nation, tests, sum(1::DOUBLE / i) AS h FROM nt, range(1, 1000000) t(i) WHERE i <= tests GROUP BY 1, 2)"


@queries.add("least_pools", f"WITH {POOLS_SQL} SELECT nation, tests, greatest(2, ceil(h / 0.05::DOUBLE - 1e-9)::BIGINT - 1) AS all_real, greatest(2, ceil(tests * h / greatest(1, round_even(tests / 4, 0)) / 0.05::DOUBLE - 1e-9)::BIGINT - 1) AS quarter_real FROM h")
def least_pools(spark, d):
    """For a family of as many correspondences as a nation has customers: pools with which all, or a quarter of them, can be told."""
    sizes = r.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("tests"))

    @F.pandas_udf("struct<all_real: long, quarter_real: long>")
    def least(tests):
        import pandas as pd

        return pd.DataFrame([(calibration.least_pool(int(n)), calibration.least_pool(int(n), corresponding=max(1, round(n / 4)))) for n in tests], columns=["all_real", "quarter_real"])

    return sizes.select("nation", "tests", least("tests").alias("p")).select("nation", "tests", "p.*")
