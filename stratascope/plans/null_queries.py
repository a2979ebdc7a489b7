"""Queries over surrogates, tests and rates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import nulls, testing
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
SEED, DRAWS = 7, 5


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::BIGINT"


def moved_sql(shift: str, keys: str = "channel", group: str = "0", draws: int = DRAWS) -> str:
    """rows, and moved AS (draw, channel, frame, value)."""
    return f"""rows AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS size FROM (SELECT *, {group} AS grp FROM ch)),
asked AS (SELECT draw, channel, grp, value, (pos + {shift}) % size AS new_pos FROM rows, range(1, {draws + 1}) d(draw)),
moved AS (SELECT draw, a.channel, b.frame, a.value FROM asked a JOIN rows b ON a.channel = b.channel AND a.grp = b.grp AND a.new_pos = b.pos)"""


CIRCULAR = "24 + " + draw_sql(str(SEED), "draw", "channel") + " % greatest(1, size - 48 + 1)"


@queries.add("circular_clock_shift", r.with_views("ch", more=moved_sql(CIRCULAR)) + "SELECT * FROM moved")
def circular_clock_shift(spark, d):
    return nulls.circular_clock_shift(r.channels(spark, d), DRAWS, 24, SEED)


@queries.add("whole_cycle_clock_shift", r.with_views("ch", more=moved_sql("24 * (1 + " + draw_sql(str(SEED), "draw", "channel") + " % greatest(1, size // 24 - 1))")) + "SELECT * FROM moved")
def whole_cycle_clock_shift(spark, d):
    return nulls.whole_cycle_clock_shift(r.channels(spark, d), DRAWS, 24, SEED)


@queries.add("within_group_clock_shift", r.with_views("ch", more=moved_sql("CASE WHEN size > 1 THEN 1 + " + draw_sql(str(SEED), "draw", "channel", "grp") + " % greatest(1, size - 1) ELSE 0 END", "channel, grp", "frame // 24")) + "SELECT * FROM moved")
def within_group_clock_shift(spark, d):
    return nulls.within_group_clock_shift(r.channels(spark, d), DRAWS, F.floor(F.col("frame") / 24), SEED)


@queries.add("block_bootstrap", r.with_views("ch", more=f"""rows AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY channel) AS size FROM ch),
asked AS (SELECT draw, channel, frame, {draw_sql(str(SEED), 'draw', 'channel', 'pos // 9')} % greatest(1, size - 9 + 1) + pos % 9 AS pos FROM rows, range(1, {DRAWS + 1}) d(draw))""") + "SELECT draw, channel, asked.frame, rows.value FROM asked JOIN rows USING (channel, pos)")
def block_bootstrap(spark, d):
    return nulls.block_bootstrap(r.channels(spark, d), DRAWS, 9, SEED)


TESTS_SQL = moved_sql(CIRCULAR, draws=39) + """,
bo AS (SELECT 0 AS draw, channel, frame, value FROM ch UNION ALL SELECT draw, channel, frame, value FROM moved),
cc AS (SELECT draw, a.channel AS driver, b.channel AS driven, lag, corr(a.value, b.value) AS r FROM bo a, range(1, 4) l(lag), ch b WHERE b.frame = a.frame + lag AND a.channel <> b.channel GROUP BY ALL),
st AS (SELECT draw, driver, driven, round(max(abs(r)), 9) AS strength FROM cc GROUP BY ALL),
mx AS (SELECT draw, max(strength) AS largest FROM st WHERE draw > 0 GROUP BY 1),
tests AS (SELECT o.driver, o.driven, o.strength AS observed, count(*) AS n, count(*) FILTER (s.strength >= o.strength) AS reached, count(*) FILTER (largest >= o.strength) AS reached_all
  FROM st o JOIN st s ON o.draw = 0 AND s.draw > 0 AND o.driver = s.driver AND o.driven = s.driven JOIN mx ON mx.draw = s.draw GROUP BY ALL)"""


def _tests(spark, d):
    record = r.channels(spark, d)
    return nulls.precedence_test(record, nulls.circular_clock_shift(record, 39, 24, SEED), [1, 2, 3])


@queries.add("precedence_tests", r.with_views("ch", more=TESTS_SQL) + f"SELECT driver, driven, {sql_round('observed')}, n, reached, {sql_round('(1 + reached) / (1 + n)', 'p_value')}, {sql_round('(1 + reached_all) / (1 + n)', 'family_p')} FROM tests")
def precedence_tests(spark, d):
    return rounded(_tests(spark, d), "observed", "p_value", "family_p")


@queries.add("screened_precedence", r.with_views("ch", more=TESTS_SQL + """,
ps AS (SELECT driver || '>' || driven AS test, (1 + reached) / (1 + n) AS p FROM tests), size AS (SELECT count(DISTINCT channel) * (count(DISTINCT channel) - 1) AS m FROM ch),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i FROM ps),
q AS (SELECT test, least(1.0, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, m FROM ranked, size)""") + f"SELECT test, {sql_round('q')}, q <= 0.05 AS significant, 39 >= ceil(m / 0.05::DOUBLE - 1e-9) - 1 AS powered FROM q")
def screened_precedence(spark, d):
    """Corrected over all ordered pairs of channels; ``powered`` tells whether the ensemble could reject any of them."""
    patterns = r.channels(spark, d).select("channel").distinct().count()
    size = patterns * (patterns - 1)
    q = testing.adjust(_tests(spark, d).select(F.concat_ws(">", "driver", "driven").alias("test"), "p_value"), size)
    return rounded(q.select("test", F.col("bh").alias("q"), (F.col("bh") <= 0.05).alias("significant"), F.lit(testing.check_power(39, size)).alias("powered")), "q")


@queries.add("two_sided_surrogates", r.with_views("ch", more=TESTS_SQL + """,
lagged AS (SELECT * FROM cc WHERE lag = 1), mid AS (SELECT driver, driven, median(r) AS middle FROM lagged WHERE draw > 0 GROUP BY 1, 2),
k AS (SELECT s.driver, s.driven, count(*) AS n, count(*) FILTER (round(abs(s.r - middle), 9) >= round(abs(o.r - middle), 9)) AS k FROM lagged s JOIN lagged o ON s.draw > 0 AND o.draw = 0 AND s.driver = o.driver AND s.driven = o.driven JOIN mid ON mid.driver = s.driver AND mid.driven = s.driven GROUP BY 1, 2)""") + f"SELECT driver, driven, n, {sql_round('(1 + k) / (1 + n)', 'p_value')} FROM k")
def two_sided_surrogates(spark, d):
    record = r.channels(spark, d)
    observed = nulls.pair_correlations(record.withColumn("draw", F.lit(0).cast("long")), record, [1]).select("driver", "driven", F.col("r").alias("observed"))
    null = nulls.pair_correlations(nulls.circular_clock_shift(record, 39, 24, SEED), record, [1]).join(observed, ["driver", "driven"])
    return rounded(nulls.two_sided_p(null, F.col("observed"), "r", "driver", "driven"), "p_value")


DISTANCES_SQL = "dist AS (SELECT a.label = b.label AS same, round(sqrt(2 * greatest(0.0, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _consecutive(spark, d):
    """(same, distance): each vector and the next one, whether their labels agree and how far apart their directions are."""
    e = r.read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    both = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    cosine = dot(F.col("a.v"), F.col("b.v")) / F.sqrt(dot(F.col("a.v"), F.col("a.v")) * dot(F.col("b.v"), F.col("b.v")))
    return both.select((F.col("a.label") == F.col("b.label")).alias("same"), F.round(F.sqrt(2 * F.greatest(F.lit(0.0), 1 - cosine)), 6).alias("distance"))


@queries.add("discrimination_curve", f"WITH {DISTANCES_SQL} SELECT radius, {sql_round('avg((distance > radius)::INT) FILTER (same)', 'false_split')}, {sql_round('avg((distance <= radius)::INT) FILTER (NOT same)', 'admission')} FROM dist, (SELECT unnest([0.6, 1.0, 1.3, 1.5])::DOUBLE AS radius) GROUP BY 1")
def discrimination_curve(spark, d):
    return rounded(nulls.discrimination_curve(_consecutive(spark, d), [0.6, 1.0, 1.3, 1.5]), "false_split", "admission")


@queries.add("recall_radius", f"WITH {DISTANCES_SQL}, pl AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY distance) AS i, count(*) OVER (PARTITION BY same) AS n FROM dist) SELECT same, n, distance AS radius FROM pl WHERE i = ceil(round(n * 0.9::DOUBLE, 9))")
def recall_radius(spark, d):
    return nulls.recall_radius(_consecutive(spark, d), 0.9, "same")
