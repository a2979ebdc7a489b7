"""Queries over gridded fields, forecasts and ensembles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import grids, verification
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
#: Rows of the field stand at latitudes from 60 south, a degree a month; cells are 1 by 2 degrees.
LAT_SQL = "(y - 60.0::DOUBLE)"
WEIGHT_SQL = f"cos(radians({LAT_SQL}))"


def latitude():
    return F.col("y") - 60.0


def weight():
    return F.cos(F.radians(latitude()))


@queries.add("area_weighted_moments", r.with_views("fld", more=f"w AS (SELECT *, {WEIGHT_SQL} AS w FROM fld), m AS (SELECT x, sum(w * value) / sum(w) AS m, sum(w * value * value) / sum(w) AS q FROM w GROUP BY 1)") + f"SELECT x, {sql_round('m', 'mean')}, {sql_round('greatest(0.0, q - m * m)', 'variance', 3)}, {sql_round('sqrt(greatest(0.0, q - m * m))', 'deviation', 4)} FROM m")
def area_weighted_moments(spark, d):
    out = grids.weighted_moments(r.field(spark, d), weight(), "x")
    return rounded(rounded(rounded(out, "mean"), "variance", digits=3), "deviation", digits=4)


ERR = "sqrt(avg(({f} - {t}) * ({f} - {t})))"
ERRORS_SQL = f"""SELECT {{keys}}{sql_round('sqrt(avg(e * e))', 'rmse', digits=4)}, {sql_round('avg(abs(e))', 'mae', digits=4)}, {sql_round('avg(e)', 'bias', digits=4)}, {sql_round('sqrt(sum(w * e * e) / sum(w))', 'weighted_rmse', digits=4)}, {sql_round('sum(w * abs(e)) / sum(w)', 'weighted_mae', digits=4)}, {sql_round('sum(w * e) / sum(w)', 'weighted_bias', digits=4)}, {sql_round('CASE WHEN sqrt(avg(e * e)) = 0 THEN 1.0 ELSE sqrt(sum(w * e * e) / sum(w)) / sqrt(avg(e * e)) END', 'effect', digits=4)} FROM w GROUP BY ALL"""


@queries.add("area_weighted_errors", r.with_views("prs", more=f"w AS (SELECT y, {WEIGHT_SQL} AS w, forecast - truth AS e, x FROM prs)") + ERRORS_SQL.replace("{keys}", "x, "))
def area_weighted_errors(spark, d):
    return rounded(grids.weighted_errors(r.pairs(spark, d), weight(), "x"), "rmse", "mae", "bias", "weighted_rmse", "weighted_mae", "weighted_bias", "effect", digits=4)


@queries.add("boundary_rings", r.with_views("prs") + f"SELECT least(y, (SELECT max(y) FROM fld) - y, x, (SELECT max(x) FROM fld) - x) AS ring, count(*) AS n, {sql_round('sqrt(avg((forecast - truth) * (forecast - truth)))', 'rmse')}, {sql_round('avg(abs(forecast - truth))', 'mae')} FROM prs GROUP BY 1")
def boundary_rings(spark, d):
    return rounded(grids.boundary_rings(r.pairs(spark, d), *r.extent(spark, d)), "rmse", "mae")


GRAD_SQL = f"""g AS (SELECT c.y, c.x, (n.value - s.value) / (2 * (6371000.0::DOUBLE * radians(1.0::DOUBLE))) AS north, (e.value - w.value) / (2 * (6371000.0::DOUBLE * cos(radians(c.y - 60.0::DOUBLE)) * radians(2.0::DOUBLE))) AS east
FROM fld c LEFT JOIN fld n ON n.y = c.y + 1 AND n.x = c.x LEFT JOIN fld s ON s.y = c.y - 1 AND s.x = c.x LEFT JOIN fld e ON e.y = c.y AND e.x = c.x + 1 LEFT JOIN fld w ON w.y = c.y AND w.x = c.x - 1)"""


@queries.add("gradient", r.with_views("fld", more=GRAD_SQL) + f"SELECT y, x, {sql_round('north', digits=9)}, {sql_round('east', digits=9)}, {sql_round('sqrt(north * north + east * east)', 'magnitude', 9)}, {sql_round('atan2(north, east)', 'direction')} FROM g")
def gradient(spark, d):
    out = grids.gradient(r.field(spark, d), latitude(), 1.0, 2.0)
    return rounded(rounded(out, "north", "east", "magnitude", digits=9), "direction")


@queries.add("laplacian", r.with_views("fld") + f"SELECT c.y, c.x, {sql_round('n.value + s.value + e.value + w.value - 4 * c.value', 'laplacian', 6)} FROM fld c JOIN fld n ON n.y = c.y + 1 AND n.x = c.x JOIN fld s ON s.y = c.y - 1 AND s.x = c.x JOIN fld e ON e.y = c.y AND e.x = c.x + 1 JOIN fld w ON w.y = c.y AND w.x = c.x - 1")
def laplacian(spark, d):
    return rounded(grids.laplacian(r.field(spark, d)), "laplacian")


def _block(source: str, out: str) -> str:
    return f"""{out} AS (SELECT y // 2 AS y, x // 2 AS x, sum(v) / 2 AS ll, sum(CASE WHEN x % 2 = 1 THEN -v ELSE v END) / 2 AS lh, sum(CASE WHEN y % 2 = 1 THEN -v ELSE v END) / 2 AS hl,
sum(CASE WHEN (y % 2 = 1) <> (x % 2 = 1) THEN -v ELSE v END) / 2 AS hh FROM {source} GROUP BY 1, 2 HAVING count(v) = 4)"""


HAAR_SQL = "f0 AS (SELECT y, x, value AS v FROM fld), " + _block("f0", "w1") + ", f1 AS (SELECT y, x, ll AS v FROM w1), " + _block("f1", "w2") + """,
e AS (SELECT 1 AS level, 'lh' AS band, lh AS c FROM w1 UNION ALL SELECT 1, 'hl', hl FROM w1 UNION ALL SELECT 1, 'hh', hh FROM w1 UNION ALL SELECT 2, 'lh', lh FROM w2 UNION ALL SELECT 2, 'hl', hl FROM w2 UNION ALL SELECT 2, 'hh', hh FROM w2 UNION ALL SELECT 2, 'll', ll FROM w2),
s AS (SELECT level, band, count(*) AS n, sum(c * c) AS energy FROM e GROUP BY 1, 2)"""


@queries.add("haar_energies", r.with_views("fld", more=HAAR_SQL) + f"SELECT level, band, n, {sql_round('energy', digits=3)}, {sql_round('energy / n', 'density', 3)}, {sql_round('energy / sum(energy) OVER ()', 'fraction')} FROM s")
def haar_energies(spark, d):
    out = grids.haar_energies(r.field(spark, d), 2)
    return rounded(rounded(out, "energy", "density", digits=3), "fraction")


@queries.add("haar_round_trip", r.with_views("fld", more="b AS (SELECT y // 2 AS b, x // 2 AS c FROM fld GROUP BY 1, 2 HAVING count(value) = 4)") + f"SELECT y, x, {sql_round('value', digits=6)} FROM fld JOIN b ON y // 2 = b AND x // 2 = c")
def haar_round_trip(spark, d):
    back = grids.inverse_haar(grids.haar(r.field(spark, d)))
    return rounded(back, "value")


@queries.add("haar_details", r.with_views("ch", more="l AS (SELECT *, lead(value, 4) OVER (PARTITION BY channel ORDER BY frame) AS later FROM ch)") + f"SELECT channel, frame, {sql_round('(value + later) / 2', 'approximation')}, {sql_round('(value - later) / 2', 'detail')} FROM l WHERE later IS NOT NULL")
def haar_details(spark, d):
    return rounded(grids.haar_detail(r.channels(spark, d), 4, "channel"), "approximation", "detail")


@queries.add("pooled_squares", r.with_views("fld") + f"SELECT y // 5 AS y, x // 5 AS x, {sql_round('avg(value)', 'value', 9)} FROM fld GROUP BY 1, 2")
def pooled_squares(spark, d):
    return rounded(grids.pooled(r.field(spark, d), 5), "value", digits=9)


@queries.add("cropped_field", r.with_views("fld") + "SELECT y - 10 AS y, x - 5 AS x, value FROM fld WHERE y >= 10 AND y < 30 AND x >= 5 AND x < 15")
def cropped_field(spark, d):
    return grids.crop(r.field(spark, d), (10, 30), (5, 15))


@queries.add("time_anomalies", r.with_views("ch") + f"SELECT channel AS y, frame, {sql_round('value - avg(value) OVER (PARTITION BY channel)', 'anomaly')} FROM ch")
def time_anomalies(spark, d):
    f = r.channels(spark, d).select(F.col("channel").alias("y"), F.lit(0).alias("x"), "frame", "value")
    return rounded(grids.time_anomalies(f).select("y", "frame", "anomaly"), "anomaly")


@queries.add("participation_ratio", f"SELECT c_nationkey, count(*) AS n, {sql_round('sum(c_acctbal) * sum(c_acctbal) / (count(*) * sum(c_acctbal * c_acctbal))', 'participation')} FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def participation_ratio(spark, d):
    return rounded(grids.participation(r.read(spark, d, "customer").where("c_acctbal > 0"), F.col("c_acctbal"), "c_nationkey"), "participation")


@queries.add("gini", f"SELECT c_mktsegment, count(*) AS n, {sql_round('2 * sum(i * c_acctbal) / (count(*) * sum(c_acctbal)) - (count(*) + 1) / count(*)', 'gini')} FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def gini(spark, d):
    return rounded(grids.gini(r.read(spark, d, "customer").where("c_acctbal > 0"), F.col("c_acctbal"), "c_mktsegment"), "gini")


COEF_SQL = "l AS (SELECT frame, k AS scale, (value - lead(value, k) OVER (PARTITION BY channel, k ORDER BY frame)) / 2 AS c FROM ch, (VALUES (1), (2), (4)) t(k)), co AS (SELECT * FROM l WHERE c IS NOT NULL), th AS (SELECT scale, 2.0 * sqrt(avg(c * c)) AS t FROM co GROUP BY 1), sg AS (SELECT frame, scale, count(*) AS n, avg(c * c) AS density, sum(c * c) * sum(c * c) / (count(*) * sum(c * c * c * c)) AS participation, avg((abs(c) > t)::INT) AS beyond FROM co JOIN th USING (scale) GROUP BY 1, 2)"


def _coefficients(spark, d):
    parts = [grids.haar_detail(r.channels(spark, d), k, "channel").select("frame", F.lit(k).alias("scale"), F.col("detail").alias("c")) for k in (1, 2, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@queries.add("scale_signature", r.with_views("ch", more=COEF_SQL) + f"SELECT frame, scale, n, {sql_round('density', digits=9)}, {sql_round('density / sum(density) OVER (PARTITION BY frame)', 'fraction')}, {sql_round('participation')}, {sql_round('beyond')} FROM sg")
def scale_signature(spark, d):
    return rounded(rounded(grids.scale_signature(_coefficients(spark, d), 2.0), "density", digits=9), "fraction", "participation", "beyond")


@queries.add("dominant_scale", r.with_views("ch", more=COEF_SQL) + "SELECT frame, arg_max(scale, (density, -scale)) AS scale FROM sg GROUP BY 1")
def dominant_scale(spark, d):
    return grids.dominant_scale(grids.scale_signature(_coefficients(spark, d), 2.0))


MAX_SQL = "mx AS (SELECT c.y, c.x, c.value FROM fld c LEFT JOIN fld n ON abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 AND (n.y <> c.y OR n.x <> c.x) GROUP BY ALL HAVING (max(n.value) IS NULL OR c.value > max(n.value)) AND c.value > (SELECT 1.0 * sqrt(avg(value * value)) FROM fld))"


@queries.add("local_maxima", r.with_views("fld", more=MAX_SQL) + "SELECT y, x, value FROM mx")
def local_maxima(spark, d):
    return grids.local_maxima(r.field(spark, d), 1.0)


@queries.add("top_features", r.with_views("fld", more=MAX_SQL) + "SELECT * FROM (SELECT y, x, value, (row_number() OVER (PARTITION BY x ORDER BY value DESC, y))::INT AS rank FROM mx) WHERE rank <= 3")
def top_features(spark, d):
    return grids.top_features(grids.local_maxima(r.field(spark, d), 1.0), 3, "x")


@queries.add("loglog_fit", f"""WITH p AS (SELECT p_brand AS b, ln(p_size) AS a, ln(p_retailprice) AS c FROM part WHERE p_size > 0 AND p_retailprice > 0),
s AS (SELECT b, count(*) AS n, count(*)::DOUBLE AS s, sum(a) AS sa, sum(c) AS sb, sum(a * a) AS saa, sum(a * c) AS sab, sum(c * c) AS sbb FROM p GROUP BY 1 HAVING count(*) >= 4),
f AS (SELECT *, (s * sab - sa * sb) / (s * saa - sa * sa) AS slope FROM s WHERE s * saa - sa * sa > 0), g AS (SELECT *, (sb - slope * sa) / s AS icept FROM f)
SELECT b AS p_brand, n, {sql_round('slope')}, {sql_round('icept', 'intercept')}, {sql_round('sqrt(greatest(0.0, sbb - icept * sb - slope * sab) / (n - 2) * s / (s * saa - sa * sa))', 'slope_error')} FROM g""")
def loglog_fit(spark, d):
    p = r.read(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(1.0).alias("w"))
    return rounded(grids.loglog_fit(p, "p_brand"), "slope", "intercept", "slope_error")


@queries.add("chunk_amplification", r.with_views("fld", more="c AS (SELECT y // 16 AS a, x // 8 AS b, count(*) AS n, count(*) FILTER (y = 20 AND x BETWEEN 3 AND 9) AS k FROM fld GROUP BY 1, 2)") + f"SELECT sum(k)::BIGINT AS wanted, sum(CASE WHEN k > 0 THEN n ELSE 0 END)::BIGINT AS touched, {sql_round('sum(CASE WHEN k > 0 THEN n ELSE 0 END) / sum(k)', 'amplification')} FROM c")
def chunk_amplification(spark, d):
    wanted = (F.col("y") == 20) & F.col("x").between(3, 9)
    return rounded(grids.chunk_amplification(r.field(spark, d), wanted, {"y": 16, "x": 8}), "amplification")


@queries.add("persistence_skill", r.with_views("mon", more="p AS (SELECT k AS lead, a.forecast - b.value AS e, a.value - b.value AS h FROM (VALUES (1), (2), (3)) t(k), mon a JOIN mon b ON a.nation = b.nation WHERE b.frame = a.frame + k)") + f"SELECT lead::BIGINT AS lead, count(e) AS n, {sql_round('sqrt(avg(e * e))', 'rmse')}, {sql_round('avg(abs(e))', 'mae')}, {sql_round('avg(e)', 'bias')}, {sql_round('CASE WHEN avg(h * h) > 0 THEN 1 - avg(e * e) / avg(h * h) END', 'skill')} FROM p GROUP BY 1")
def persistence_skill(spark, d):
    return rounded(verification.persistence_skill(r.monthly(spark, d), [1, 2, 3], "nation"), "rmse", "mae", "bias", "skill")


@queries.add("matched_truth", r.with_views("mon") + f"SELECT a.nation, a.frame AS init, 2::BIGINT AS lead, a.frame + 2 AS time, {sql_round('a.forecast', 'forecast')}, b.value AS truth FROM mon a JOIN mon b ON a.nation = b.nation AND b.frame = a.frame + 2")
def matched_truth(spark, d):
    m = r.monthly(spark, d)
    out = verification.matched_truth(m.select("nation", F.col("frame").alias("init"), F.lit(2).cast("long").alias("lead"), "forecast"), m.select("nation", F.col("frame").alias("time"), "value"), "nation")
    return rounded(out, "forecast")


@queries.add("ensemble_crps", r.with_views("ens", more="i AS (SELECT *, row_number() OVER (PARTITION BY nation, frame ORDER BY value) AS i, count(*) OVER (PARTITION BY nation, frame) AS m FROM ens)") + f"SELECT nation, frame, count(*) AS members, {sql_round('avg(abs(value - truth)) - sum((2 * i - m - 1) * value / (m * m))', 'crps', 9)} FROM i GROUP BY 1, 2")
def ensemble_crps(spark, d):
    return rounded(verification.crps(r.ensemble(spark, d), "nation", "frame"), "crps", digits=9)


@queries.add("rank_histogram", r.with_views("ens", more="u AS (SELECT count(*) FILTER (value < truth) AS u, count(*) FILTER (value = truth) AS q FROM ens GROUP BY nation, frame), k AS (SELECT unnest(range(u, u + q + 1)) AS rank, q FROM u)") + f"SELECT rank, {sql_round('sum(1 / (q + 1))', 'share')} FROM k GROUP BY 1")
def rank_histogram(spark, d):
    return rounded(verification.rank_histogram(r.ensemble(spark, d), "nation", "frame"), "share")


@queries.add("spread_skill", r.with_views("ens", more="g AS (SELECT nation, var_pop(value) AS v, avg(value) - any_value(truth) AS e, cos(radians(nation)) AS w FROM ens GROUP BY nation, frame)") + f"SELECT count(*) AS n, {sql_round('sqrt(sum(w * v) / sum(w))', 'spread')}, {sql_round('sqrt(sum(w * e * e) / sum(w))', 'rmse')}, {sql_round('sqrt(sum(w * v) / sum(w)) / sqrt(sum(w * e * e) / sum(w))', 'ratio')} FROM g")
def spread_skill(spark, d):
    return rounded(verification.spread_skill(r.ensemble(spark, d), F.cos(F.radians(F.col("nation").cast("double"))), "nation", "frame"), "spread", "rmse", "ratio")


@queries.add("errors_by_lead", r.with_views("ens") + f"SELECT member, count(*) AS n, {sql_round('sqrt(avg((value - truth) * (value - truth)))', 'rmse')}, {sql_round('avg(abs(value - truth))', 'mae')}, {sql_round('avg(value - truth)', 'bias')} FROM ens GROUP BY 1")
def errors_by_lead(spark, d):
    out = verification.errors_by(r.ensemble(spark, d).withColumnRenamed("value", "forecast").withColumn("member", F.col("member").cast("long")), "member")
    return rounded(out, "rmse", "mae", "bias")


@queries.add("overlap_compare", f"""WITH a AS (SELECT {r.DAY.format('o_orderdate')} AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT {r.DAY.format('l_shipdate')} AS t, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), p AS (SELECT abs(a.v - b.v) AS d, b.v FROM a JOIN b USING (t))
SELECT count(*) AS shared, count(*) FILTER (d > 100.0 + 0.5 * abs(v)) AS mismatched, {sql_round('max(d)', 'most', 4)}, {sql_round('avg(d)', 'mean_abs', 4)}, {sql_round('sqrt(avg(d * d))', 'rmse', 4)} FROM p""")
def overlap_compare(spark, d):
    a = r.read(spark, d, "orders").groupBy(r.day("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("value"))
    b = r.read(spark, d, "lineitem").groupBy(r.day("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("value"))
    return rounded(verification.compare_sources(a, b, ["t"], 0.5, 100.0), "most", "mean_abs", "rmse", digits=4)


@queries.add("compare_rows", """WITH a AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size > 10), b AS (SELECT p_partkey AS k, p_retailprice + p_size / 10.0::DOUBLE AS v FROM part WHERE p_size < 40)
SELECT CASE WHEN b.k IS NULL THEN 'only_observed' WHEN a.k IS NULL THEN 'only_recorded' WHEN abs(a.v - b.v) <= 2.05 THEN 'agrees' ELSE 'differs' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def compare_rows(spark, d):
    p = r.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("value"), "p_size")
    return verification.compare_rows(p.where("p_size > 10"), p.where("p_size < 40").withColumn("value", F.col("value") + F.col("p_size") / 10.0), "k", 2.05)


@queries.add("join_segments", r.with_views("fld") + "SELECT y, x, value, true AS ok FROM fld")
def join_segments(spark, d):
    f = r.field(spark, d)
    return verification.join_segments(f.where("x <= 12"), f.where("x >= 12"), ["y", "x"], 1e-9)
