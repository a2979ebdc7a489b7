"""Queries over transforms of whole frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.folders import stored
from stratascope.operators import dual_tree, spectra
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
LEVELS = 2

FRAMES_SQL = """og AS (SELECT o_orderpriority AS kind, m - (SELECT min(m) FROM omk) AS y, x, round(sum(o_totalprice), 2) / 1000 AS value FROM omk GROUP BY 1, 2, 3),
kinds AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS frame FROM (SELECT DISTINCT kind FROM og)), ex AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM og),
frm AS MATERIALIZED (SELECT frame, yy AS y, xx AS x, coalesce(value, 0.0) AS value FROM kinds, ex, range(0, h) a(yy), range(0, w) b(xx) LEFT JOIN og ON og.kind = kinds.kind AND og.y = yy AND og.x = xx)"""
SOURCE_SQL = "omk AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS m, c_nationkey::BIGINT AS x, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)"


def frames(spark, d):
    """(frame, y, x, value): revenue by month and nation, a frame for each priority of orders; no order is no revenue."""
    c = r.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("x"))
    o = r.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("m", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long"))
    g = stored(o.groupBy("o_orderpriority", "m", "x").agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("value")), "frames")
    low, high, width = g.agg(F.min("m"), F.max("m"), F.max("x")).first()
    height, width = (0, 0) if low is None else (high - low + 1, width + 1)
    kinds = [row[0] for row in g.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # a declared, short list
    kind = spark.createDataFrame([(k, i) for i, k in enumerate(kinds)], "o_orderpriority string, frame long")
    cells = spark.range(len(kinds) * height * width).select((F.col("id") / (height * width)).cast("long").alias("frame"), ((F.col("id") / width).cast("long") % height).alias("y"), (F.col("id") % width).alias("x"))
    own = g.join(F.broadcast(kind), "o_orderpriority").select("frame", (F.col("m") - low).alias("y"), "x", "value")
    return stored(cells.join(own, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value")), "frames"), height, width


def _taps_sql() -> str:
    rows = [(level, tree, kind, k, float(h)) for level in (1, 2) for tree in dual_tree.TREES for kind, taps in zip("lh", dual_tree.filters(level, tree)) for k, h in enumerate(taps) if h]
    return "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {k}, {h!r}::DOUBLE)" for a, b, c, k, h in rows) + ") t(level, tree, kind, k, h))"


def _split_sql(level: int, source: str) -> str:
    """source: frame, i, j, y, x, v. Along y with tree i and along x with tree j."""
    return f"""n{level} AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM {source}),
y{level} AS (SELECT frame, i, j, kind AS ky, ((y - k + 10 * n.h) % n.h) // 2 AS y, x, sum(t.h * v) AS v FROM {source} JOIN taps t ON t.level = {level} AND t.tree = i, n{level} n WHERE ((y - k + 10 * n.h) % n.h) % 2 = 0 GROUP BY ALL),
x{level} AS MATERIALIZED (SELECT frame, i, j, ky, kind AS kx, y, ((x - k + 10 * n.w) % n.w) // 2 AS x, sum(t.h * v) AS v FROM y{level} JOIN taps t ON t.level = {level} AND t.tree = j, n{level} n WHERE ((x - k + 10 * n.w) % n.w) % 2 = 0 GROUP BY ALL),
b{level} AS (SELECT frame, {level} AS level, CASE ky || kx WHEN 'lh' THEN 0 WHEN 'hh' THEN 2 ELSE 4 END AS band, y, x, sum(v) FILTER (i = 'a' AND j = 'a') AS aa, sum(v) FILTER (i = 'a' AND j = 'b') AS ab, sum(v) FILTER (i = 'b' AND j = 'a') AS ba, sum(v) FILTER (i = 'b' AND j = 'b') AS bb FROM x{level} WHERE ky || kx <> 'll' GROUP BY ALL),
l{level} AS (SELECT frame, i, j, y, x, v FROM x{level} WHERE ky || kx = 'll')"""


DUAL_SQL = f"""{SOURCE_SQL}, {FRAMES_SQL}, {_taps_sql()},
l0 AS (SELECT frame, i, j, yy AS y, xx AS x, value / 2 AS v FROM ex, range(0, ((h + 3) // 4) * 4) a(yy), range(0, ((w + 3) // 4) * 4) b(xx) JOIN frm ON frm.y = least(yy, h - 1) AND frm.x = least(xx, w - 1), (SELECT unnest(['a', 'b']) AS i), (SELECT unnest(['a', 'b']) AS j)),
{_split_sql(1, 'l0')}, {_split_sql(2, 'l1')},
both_ AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
co AS (SELECT frame, level, band, y, x, sqrt(0.5) * (aa - bb) AS re, sqrt(0.5) * (ab + ba) AS im FROM both_ UNION ALL SELECT frame, level, band + 1, y, x, sqrt(0.5) * (aa + bb), sqrt(0.5) * (ab - ba) FROM both_
  UNION ALL SELECT frame, 2, 6 + CASE i WHEN 'a' THEN 0 ELSE 2 END + CASE j WHEN 'a' THEN 0 ELSE 1 END, y, x, v, 0.0 FROM l2)"""


def _coefficients(spark, d):
    f, height, width = frames(spark, d)
    return dual_tree.dual_tree(f, height, width, LEVELS), height, width


@queries.add("dual_tree_coefficients", f"WITH {DUAL_SQL} SELECT frame, level::INT AS level, band::INT AS band, y::INT AS y, x::INT AS x, {sql_round('re', digits=5)}, {sql_round('im', digits=5)} FROM co")
def dual_tree_coefficients(spark, d):
    return rounded(_coefficients(spark, d)[0], "re", "im", digits=5)


@queries.add("dual_tree_inverse", f"WITH {SOURCE_SQL}, {FRAMES_SQL} SELECT frame, y::INT AS y, x::INT AS x, {sql_round('value', digits=7)} FROM frm")
def dual_tree_inverse(spark, d):
    """The coefficients give the frames back."""
    return rounded(dual_tree.inverse_dual_tree(*_coefficients(spark, d), LEVELS), "value", digits=7)


@queries.add("dual_tree_energies", f"WITH {DUAL_SQL}, g AS (SELECT frame, level, CASE WHEN band < 6 THEN band END AS band, sum(re * re + im * im) AS energy FROM co GROUP BY ALL) SELECT frame, level::INT AS level, band::INT AS band, {sql_round('energy', digits=1)}, {sql_round('energy / sum(energy) OVER (PARTITION BY frame)', 'fraction')} FROM g")
def dual_tree_energies(spark, d):
    return rounded(rounded(dual_tree.band_energies(_coefficients(spark, d)[0]), "energy", digits=1), "fraction")


def _dft_sql(source: str, value: str, out: str) -> str:
    """out: frame, ky, kx, re, im of a column of a source with rows from 0; extents in ``sz``."""
    return f"""{out}_x AS MATERIALIZED (SELECT frame, y, kx, sum({value} * cos(2 * pi() * kx * x / w)) AS re, sum(-{value} * sin(2 * pi() * kx * x / w)) AS im FROM {source}, sz, range(0, w) t(kx) GROUP BY 1, 2, 3),
{out} AS MATERIALIZED (SELECT frame, ky, kx, sum(re * cos(2 * pi() * ky * y / h) + im * sin(2 * pi() * ky * y / h)) AS re, sum(im * cos(2 * pi() * ky * y / h) - re * sin(2 * pi() * ky * y / h)) AS im FROM {out}_x, sz, range(0, h) t(ky) GROUP BY 1, 2, 3)"""


ALL_SQL = f"{SOURCE_SQL}, {FRAMES_SQL}, sz AS (SELECT h::BIGINT AS h, w::BIGINT AS w FROM ex)"
PAIRS_SQL = f"{SOURCE_SQL}, {FRAMES_SQL}, sz AS (SELECT h::BIGINT - 1 AS h, w::BIGINT AS w FROM ex), pr AS (SELECT a.frame, b.y AS y, a.x, a.value AS truth, b.value AS forecast FROM frm a JOIN frm b ON a.frame = b.frame AND a.x = b.x AND a.y = b.y + 1)"


def _pairs(spark, d):
    """A cell's revenue and the month before's as its forecast, a frame for each priority."""
    f, height, width = frames(spark, d)
    before = f.select("frame", (F.col("y") + 1).alias("y"), "x", F.col("value").alias("forecast"))
    return f.withColumnRenamed("value", "truth").join(before, ["frame", "y", "x"]).select("frame", (F.col("y") - 1).alias("y"), "x", "truth", "forecast"), height - 1, width


@queries.add("fourier_coefficients", f"WITH {ALL_SQL}, {_dft_sql('frm', 'value', 'co')} SELECT frame, ky::INT AS ky, kx::INT AS kx, {sql_round('re', 'value_re', 4)}, {sql_round('im', 'value_im', 4)} FROM co")
def fourier_coefficients(spark, d):
    return rounded(spectra.fourier(*frames(spark, d)), "value_re", "value_im", digits=4)


@queries.add("fourier_inverse", f"WITH {ALL_SQL} SELECT frame, y::INT AS y, x::INT AS x, {sql_round('value', digits=7)} FROM frm")
def fourier_inverse(spark, d):
    f, height, width = frames(spark, d)
    return rounded(spectra.inverse_fourier(spectra.fourier(f, height, width), height, width), "value", digits=7)


def _dct_sql(k: str, n: str, at: str) -> str:
    return f"(CASE {k} WHEN 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos(pi() * ({at} + 0.5) * {k} / {n}))"


@queries.add("cosine_coefficients", f"WITH {ALL_SQL}, cx AS MATERIALIZED (SELECT frame, y, kx, sum(value * {_dct_sql('kx', 'w', 'x')}) AS v FROM frm, sz, range(0, w) t(kx) GROUP BY 1, 2, 3) SELECT frame, ky::INT AS ky, kx::INT AS kx, {sql_round(f'sum(v * ' + _dct_sql('ky', 'h', 'y') + ')', 'value', 5)} FROM cx, sz, range(0, h) t(ky) GROUP BY 1, 2, 3")
def cosine_coefficients(spark, d):
    return rounded(spectra.cosine(*frames(spark, d)), "value", digits=5)


@queries.add("cosine_inverse", f"WITH {ALL_SQL} SELECT frame, y::INT AS y, x::INT AS x, {sql_round('value', digits=7)} FROM frm")
def cosine_inverse(spark, d):
    f, height, width = frames(spark, d)
    return rounded(spectra.inverse_cosine(spectra.cosine(f, height, width), height, width), "value", digits=7)


WHOLE = "sqrt(power(CASE WHEN ky < (h + 1) // 2 THEN ky ELSE ky - h END, 2) + power(CASE WHEN kx < (w + 1) // 2 THEN kx ELSE kx - w END, 2))"


@queries.add("errors_by_scale", f"""WITH {PAIRS_SQL}, er AS (SELECT frame, y, x, forecast - truth AS e FROM pr), {_dft_sql('er', 'e', 'co')}, p AS (SELECT frame, {WHOLE} AS r, (re * re + im * im) / ((h * w)::DOUBLE * (h * w)) AS p, 0.15::DOUBLE * (least(h, w) // 2) AS low, 0.4::DOUBLE * (least(h, w) // 2) AS high FROM co, sz),
t AS (SELECT frame, avg(e * e) AS m FROM er GROUP BY 1)
SELECT frame, {sql_round('sqrt(coalesce(sum(p) FILTER (r <= low), 0))', 'low_rmse')}, {sql_round('sqrt(coalesce(sum(p) FILTER (r > low AND r <= high), 0))', 'mid_rmse')}, {sql_round('sqrt(coalesce(sum(p) FILTER (r > high), 0))', 'high_rmse')}, {sql_round('sqrt(any_value(m))', 'total_rmse')} FROM p JOIN t USING (frame) GROUP BY 1""")
def errors_by_scale(spark, d):
    return rounded(spectra.errors_by_scale(*_pairs(spark, d)), "low_rmse", "mid_rmse", "high_rmse", "total_rmse")


@queries.add("spectral_coherence", f"""WITH {PAIRS_SQL}, {_dft_sql('pr', 'truth', 'ct')}, {_dft_sql('pr', 'forecast', 'cf')},
b AS (SELECT *, greatest(least(h, w) // 2, 2) AS bands, least((h // 2) / h::DOUBLE, (w // 2) / w::DOUBLE) / greatest(least(h, w) // 2, 2) AS step FROM sz),
j AS (SELECT t.frame, t.re AS tr, t.im AS ti, f.re AS fr, f.im AS fi, sqrt(power(CASE WHEN ky < (h + 1) // 2 THEN ky ELSE ky - h END / h::DOUBLE, 2) + power(CASE WHEN kx < (w + 1) // 2 THEN kx ELSE kx - w END / w::DOUBLE, 2)) AS k, step, bands FROM ct t JOIN cf f USING (frame, ky, kx), b),
g AS (SELECT frame, floor(k / step)::INT AS band, count(*) AS n, avg(k) * 2 * pi() AS k, power(sum(fr * tr + fi * ti), 2) + power(sum(fi * tr - fr * ti), 2) AS c, sum(tr * tr + ti * ti) * sum(fr * fr + fi * fi) AS p FROM j WHERE k > 0 AND floor(k / step) < bands GROUP BY 1, 2)
SELECT frame, band, n, {sql_round('k')}, {sql_round('CASE WHEN p > 0 THEN c / p ELSE 0 END', 'coherence')} FROM g""")
def spectral_coherence(spark, d):
    return rounded(spectra.coherence(*_pairs(spark, d)), "k", "coherence")
