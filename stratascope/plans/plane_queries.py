"""Queries over grids, tapers, padding and comparisons of fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import planes
from stratascope.plans import recasts as r
from stratascope.plans.null_queries import draw_sql
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
R = "6371.0::DOUBLE"
EXTENT_SQL = "ex AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM fld)"


@queries.add("grid_geometry", r.with_views("fld", more=f"""g AS (SELECT y, x, y - 60.0::DOUBLE AS lat, (300 + 2.0::DOUBLE * x) % 360 AS lon, 1000 * {R} * cos(radians(y - 60.0::DOUBLE)) * radians(2.0::DOUBLE) AS dx,
{R} * {R} * radians(2.0::DOUBLE) * (sin(radians(least(90.0, y - 59.5::DOUBLE))) - sin(radians(greatest(-90.0, y - 60.5::DOUBLE)))) AS area FROM fld)""") + f"SELECT y, x, {sql_round('lat')}, {sql_round('lon')}, {sql_round('dx', 'dx_metres', 3)}, {sql_round('area', 'area_km2', 3)}, {sql_round('area / sum(area) OVER ()', 'weight', 9)}, {sql_round(f'1000 * {R} * radians(1.0::DOUBLE) / dx', 'aspect')} FROM g")
def grid_geometry(spark, d):
    out = planes.with_geometry(r.field(spark, d), -60.0, 1.0, 300.0, 2.0).drop("value")
    return rounded(rounded(rounded(out, "lat", "lon", "aspect"), "dx_metres", "area_km2", digits=3), "weight", digits=9)


@queries.add("wavenumbers", r.with_views("fld", more=EXTENT_SQL + ", k AS (SELECT y, x, CASE WHEN y < (h + 1) // 2 THEN y ELSE y - h END / h AS ky, CASE WHEN x < (w + 1) // 2 THEN x ELSE x - w END / w AS kx FROM fld, ex)") + f"SELECT y, x, {sql_round('ky')}, {sql_round('kx')}, {sql_round('sqrt(ky * ky + kx * kx)', 'k')}, sqrt(ky * ky + kx * kx) <= 0.5 AS resolved FROM k")
def wavenumbers(spark, d):
    out = planes.with_wavenumbers(r.field(spark, d), *r.extent(spark, d)).withColumn("resolved", F.col("k") <= planes.nyquist(1.0)).drop("value")
    return rounded(out, "ky", "kx", "k")


def _hann(i: str, n: str) -> str:
    return f"(0.5 - 0.5 * cos(2 * pi() * {i} / ({n} - 1)))"


def _tukey(i: str, n: str) -> str:
    near, edge = f"least({i}, {n} - 1 - {i})", f"(0.5 * ({n} - 1) / 2)"
    return f"(CASE WHEN {near} >= {edge} THEN 1.0 ELSE 0.5 * (1 + cos(pi() * ({near} / {edge} - 1))) END)"


@queries.add("tapered_field", r.with_views("fld", more=EXTENT_SQL) + f"SELECT y, x, {sql_round('value * ' + _hann('y', 'h') + ' * ' + _hann('x', 'w'), 'hann', 9)}, {sql_round('value * ' + _tukey('y', 'h') + ' * ' + _tukey('x', 'w'), 'tukey', 9)} FROM fld, ex")
def tapered_field(spark, d):
    f, size = r.field(spark, d), r.extent(spark, d)
    hann = planes.tapered(f, *size, "hann").withColumnRenamed("value", "hann")
    return rounded(hann.join(planes.tapered(f, *size, "tukey", 0.5).withColumnRenamed("value", "tukey"), ["y", "x"]), "hann", "tukey", digits=9)


def _padded_sql(y: str, x: str, out: str) -> str:
    return f"SELECT p.y, p.x, '{out}' AS treatment, {'coalesce(value, 0.0)' if out == 'zero' else 'value'} AS value FROM (SELECT *, {y} AS fy, {x} AS fx FROM pad) p LEFT JOIN fld ON fld.y = fy AND fld.x = fx"


_back = lambda i, n: f"least((({i}) + 4 * (2 * {n} - 2)) % (2 * {n} - 2), 2 * {n} - 2 - (({i}) + 4 * (2 * {n} - 2)) % (2 * {n} - 2))"


@queries.add("padded_fields", r.with_views("fld", more=EXTENT_SQL + ", pad AS (SELECT y, x, h, w FROM ex, range(-3, 2000) a(y), range(-3, 200) b(x) WHERE y < h + 3 AND x < w + 3)") + " UNION ALL ".join([
    _padded_sql("(y + h) % h", "(x + w) % w", "periodic"), _padded_sql("least(greatest(y, 0), h - 1)", "least(greatest(x, 0), w - 1)", "replicate"), _padded_sql(_back("y", "h"), _back("x", "w"), "reflect"), _padded_sql("y", "x", "zero")]))
def padded_fields(spark, d):
    f, size = r.field(spark, d), r.extent(spark, d)
    parts = [planes.padded(f, *size, 3, t).withColumn("treatment", F.lit(t)) for t in ("periodic", "replicate", "reflect", "zero")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@queries.add("pooled_field", r.with_views("fld") + f"SELECT y // 4 AS y, x // 5 AS x, count(value) AS n, {sql_round('avg(value)', 'value', 9)} FROM fld GROUP BY 1, 2")
def pooled_field(spark, d):
    return rounded(planes.pooled(r.field(spark, d), 4, 5), "value", digits=9)


@queries.add("noisy_field", r.with_views("fld") + f"SELECT y, x, {sql_round('value + 0.5::DOUBLE * (2 * ' + draw_sql('11', 'y', 'x') + ' / 281474976710656.0::DOUBLE - 1)', 'value')} FROM fld")
def noisy_field(spark, d):
    return rounded(planes.noisy(r.field(spark, d), 0.5, 11), "value")


@queries.add("spherical_laplacian", r.with_views("fld", more="""g AS (SELECT c.y, c.x, c.y - 60.0::DOUBLE AS lat, c.value AS v, n.value AS n, s.value AS s, e.value AS e, w.value AS w FROM fld c
JOIN fld n ON n.y = c.y + 1 AND n.x = c.x JOIN fld s ON s.y = c.y - 1 AND s.x = c.x JOIN fld e ON e.y = c.y AND e.x = c.x + 1 JOIN fld w ON w.y = c.y AND w.x = c.x - 1)""") + f"""SELECT y, x, {sql_round('''1e6::DOUBLE * ((cos(radians(lat + 0.5::DOUBLE)) * (n - v) - cos(radians(lat - 0.5::DOUBLE)) * (v - s)) / (radians(1.0::DOUBLE) * radians(1.0::DOUBLE) * cos(radians(lat)))
+ (e - 2 * v + w) / (radians(2.0::DOUBLE) * radians(2.0::DOUBLE) * cos(radians(lat)) * cos(radians(lat)))) / (6371000.0::DOUBLE * 6371000.0::DOUBLE)''', 'laplacian', 6)} FROM g""")
def spherical_laplacian(spark, d):
    """In units of the value a square kilometre."""
    out = planes.spherical_laplacian(r.field(spark, d), F.col("y") - 60.0, 1.0, 2.0)
    return rounded(out.withColumn("laplacian", 1e6 * F.col("laplacian")), "laplacian")


@queries.add("field_likeness", r.with_views("prs", more="""m AS (SELECT x, count(*) AS n, avg((forecast - truth) * (forecast - truth)) AS mse, CASE WHEN max(truth) > min(truth) THEN max(truth) - min(truth) ELSE 1.0 END AS rg, avg(truth) AS mt, avg(forecast) AS mf, var_samp(truth) AS vt, var_samp(forecast) AS vf, covar_pop(truth, forecast) AS c FROM prs GROUP BY 1),
q AS (SELECT *, (0.01::DOUBLE * rg) ** 2 AS c1, (0.03::DOUBLE * rg) ** 2 AS c2 FROM m)""") + f"SELECT x, n, {sql_round('mse', digits=3)}, {sql_round('sqrt(mse)', 'rmse', 4)}, {sql_round('20 * log10(rg / (sqrt(mse) + 1e-8))', 'psnr')}, {sql_round('(2 * mt * mf + c1) * (2 * c + c2) / ((mt * mt + mf * mf + c1) * (vt + vf + c2))', 'ssim')} FROM q")
def field_likeness(spark, d):
    return rounded(rounded(rounded(planes.likeness(r.pairs(spark, d), "x"), "mse", digits=3), "rmse", digits=4), "psnr", "ssim")


@queries.add("sample_moments", f"SELECT event_type AS channel, {r.HOUR.format('ts')} AS frame, count(value) AS n, {sql_round('avg(value)', 'mean', 8)}, {sql_round('var_pop(value)', 'variance', 8)}, {sql_round('avg(value * value)', 'energy_density', 8)} FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2")
def sample_moments(spark, d):
    e = r.read(spark, d, "events").where("event_type IS NOT NULL AND ts IS NOT NULL").select(F.col("event_type").alias("channel"), r.hour("ts").alias("frame"), "value")
    return rounded(planes.sample_moments(e, "channel", "frame"), "mean", "variance", "energy_density", digits=8)


@queries.add("sequence_summary", r.with_views("uev") + "SELECT pattern, count(*) AS n, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 - count(*) AS missing FROM uev GROUP BY 1")
def sequence_summary(spark, d):
    return planes.sequence_summary(r.user_series(spark, d), "pattern")


@queries.add("day_discrepancy", f"SELECT l_orderkey AS orderkey, l_linenumber AS line, {r.SECONDS.format('l_shipdate')} - {r.SECONDS.format('o_orderdate')} AS elapsed, ({r.DAY.format('l_shipdate')} - {r.DAY.format('o_orderdate')}) * 86400 AS nominal, {r.SECONDS.format('l_shipdate')} - {r.SECONDS.format('o_orderdate')} - ({r.DAY.format('l_shipdate')} - {r.DAY.format('o_orderdate')}) * 86400 AS discrepancy FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def day_discrepancy(spark, d):
    """Seconds between order and shipment against whole days of 86,400 seconds."""
    from stratascope.operators.clocks import seconds

    both = r.read(spark, d, "lineitem").join(r.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    elapsed = seconds(F.col("l_shipdate")) - seconds(F.col("o_orderdate"))
    nominal = (r.day("l_shipdate") - r.day("o_orderdate")) * 86400
    return both.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), elapsed.alias("elapsed"), nominal.alias("nominal"), (elapsed - nominal).alias("discrepancy"))
