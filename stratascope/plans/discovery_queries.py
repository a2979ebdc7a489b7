"""Queries over motifs, relations, lags, bounds and undecimated wavelets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.functions import geometry
from stratascope.operators import discovery
from stratascope.plans import recasts as r
from stratascope.plans.plane_queries import EXTENT_SQL
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()

MOTIF_SQL = "m AS (SELECT DISTINCT l_orderkey AS scene, p_brand AS member FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT a.scene, a.member || '+' || b.member AS motif FROM m a JOIN m b ON a.scene = b.scene AND a.member < b.member)"


def _occurrences(spark, d):
    """Brands (members) of an order (scene), two at a time; an order has few lines."""
    m = r.read(spark, d, "lineitem").join(r.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("scene"), F.col("p_brand").alias("member"))
    return discovery.motif_occurrences(m, 2, 64), m


@queries.add("mined_motifs", f"WITH {MOTIF_SQL} SELECT motif, count(DISTINCT scene) AS support FROM o GROUP BY 1 HAVING count(DISTINCT scene) >= 5")
def mined_motifs(spark, d):
    return discovery.mined_motifs(_occurrences(spark, d)[0], 5)


@queries.add("confirmed_motifs", f"""WITH {MOTIF_SQL}, n AS (SELECT count(*) FILTER (scene % 2 = 0) AS nf, count(*) FILTER (scene % 2 = 1) AS nh FROM (SELECT DISTINCT scene FROM m)),
f AS (SELECT motif, count(DISTINCT scene) AS support FROM o WHERE scene % 2 = 0 GROUP BY 1 HAVING count(DISTINCT scene) >= 3), k AS (SELECT *, row_number() OVER (ORDER BY support DESC, motif) AS rank FROM f),
h AS (SELECT motif, count(DISTINCT scene) AS hs FROM o WHERE scene % 2 = 1 GROUP BY 1)""" + f"SELECT motif, support, {sql_round('support / nf', 'share')}, rank::INT AS rank, coalesce(hs, 0) AS held_support, {sql_round('coalesce(hs, 0) / nh', 'held_share')}, {sql_round('(coalesce(hs, 0) / nh) / (support / nf)', 'lift')} FROM k LEFT JOIN h USING (motif), n WHERE rank <= 20")
def confirmed_motifs(spark, d):
    found, scenes = _occurrences(spark, d)
    return rounded(discovery.confirmed_motifs(found, scenes, F.col("scene") % 2 == 1, 3, 20), "share", "held_share", "lift")


FEATURE = "struct_pack(y := l_linenumber * 10.0::DOUBLE, x := l_quantity, scale := 1 + l_discount * 100, extent := 1 + l_extendedprice / 1000, \"time\" := {day}, duration := 1 + l_tax * 100, angle := (l_partkey % 360)::DOUBLE)".format(day=r.DAY.format("l_shipdate"))
BACK = "degrees(atan2(-dx, -dy)) - b.angle + 180"
RELATIONS_SQL = f"f AS (SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, {FEATURE} AS f FROM lineitem), p AS (SELECT a.orderkey, a.line, a.part, a.supp, b.part AS next_part, b.supp AS next_supp, a.f AS a, b.f AS b FROM f a JOIN f b ON a.orderkey = b.orderkey AND b.line = a.line + 1), q AS (SELECT *, b.y - a.y AS dy, b.x - a.x AS dx, (b.\"time\" - a.\"time\")::DOUBLE AS dt FROM p), s AS (SELECT *, sqrt(dy * dy + dx * dx) AS apart, dt / sqrt(a.duration * b.duration) AS lg, degrees(atan2(dx, dy)) - a.angle + 180 AS turn, {BACK} AS back FROM q), t AS (SELECT *, cos(radians(turn - floor(turn / 360) * 360 - 180)) + cos(radians(back - floor(back / 360) * 360 - 180)) AS inward FROM s)"


@queries.add("feature_relations", f"WITH {RELATIONS_SQL} SELECT orderkey, line, part, supp, next_part, next_supp, {sql_round('apart / sqrt(a.scale * b.scale)', 'distance')}, {sql_round('a.scale / b.scale', 'relative_scale')}, {sql_round('lg', 'lag')}, {sql_round('turn - floor(turn / 360) * 360 - 180', 'direction')}, {sql_round('(a.extent - (apart + b.extent)) / a.extent', 'containment')}, (a.extent - (apart + b.extent)) / a.extent >= 0 AS contained, sign(dt)::INT AS succession, abs(lg) <= 1 AS co_occur, {sql_round('inward', 'convergence')}, inward > 0 AS converging FROM t")
def feature_relations(spark, d):
    """Each line of an order and those of the next number, as features of a scene."""
    feature = F.struct((F.col("l_linenumber") * 10.0).alias("y"), F.col("l_quantity").alias("x"), (1 + F.col("l_discount") * 100).alias("scale"), (1 + F.col("l_extendedprice") / 1000).alias("extent"), r.day("l_shipdate").alias("time"), (1 + F.col("l_tax") * 100).alias("duration"), (F.col("l_partkey") % 360).cast("double").alias("angle"))
    lines = r.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), feature.alias("f"))
    pairs = lines.withColumnRenamed("f", "a").join(lines.select("orderkey", (F.col("line") - 1).alias("line"), F.col("part").alias("next_part"), F.col("supp").alias("next_supp"), F.col("f").alias("b")), ["orderkey", "line"])
    return rounded(discovery.relations(pairs, 360.0, directed=True).drop("a", "b"), "distance", "relative_scale", "lag", "direction", "containment", "convergence")


@queries.add("interior_cells", r.with_views("fld", more=EXTENT_SQL + ", l AS (SELECT j AS level, 3 * (2 ** j - 1) + 1 AS support FROM range(1, 5) t(j))") + "SELECT level::INT AS level, support::INT AS support, (support - 1)::INT AS halfwidth, count(*) FILTER (least(y, h - 1 - y, x, w - 1 - x) >= support - 1) AS cells FROM fld, ex, l GROUP BY 1, 2, 3")
def interior_cells(spark, d):
    """For a filter of four taps."""
    return discovery.interior_cells(r.field(spark, d), *r.extent(spark, d), 4, 4)


LAGS_SQL = "w AS (SELECT max(1000 * 6371.0::DOUBLE * cos(radians(y - 60.0::DOUBLE)) * radians(2.0::DOUBLE)) AS m FROM fld), l AS (SELECT j::INT AS level, (3 * (2 ** j - 1) + 1)::INT AS support FROM range(1, 5) t(j)), fl AS (SELECT level, support, ceil(round(support * m / (10 * 86400.0::DOUBLE), 9))::BIGINT AS floor FROM l, w)"


@queries.add("physical_lags", r.with_views("fld", more=LAGS_SQL) + "SELECT level, support, floor, lag_seconds, CASE WHEN lag_seconds % 86400 = 0 THEN lag_seconds / 86400 END AS frames, coalesce(CASE WHEN lag_seconds % 86400 = 0 THEN (lag_seconds / 86400)::BIGINT END >= floor, false) AS admissible FROM fl, (SELECT unnest([86400, 100000, 432000, 864000, 1728000])::DOUBLE AS lag_seconds)")
def physical_lags(spark, d):
    """Lags in days for each level of a filter of four taps, at ten metres a second over the field's widest cell."""
    f = r.field(spark, d)
    levels = discovery.interior_cells(f, *r.extent(spark, d), 4, 4).select("level", "support")
    widest = f.agg(F.max(geometry.dx_metres(F.col("y") - 60.0, 2.0)).alias("metres"))
    floors = discovery.lag_floors(levels.crossJoin(F.broadcast(widest)), F.col("metres"), 10.0, 86400.0).drop("metres")
    out = discovery.physical_lags(floors, [86400, 100000, 432000, 864000, 1728000], 86400.0)
    return out.withColumn("frames", F.col("frames").cast("double"))


@queries.add("tolerance_bounds", f"""WITH v AS (SELECT c_nationkey AS nation, abs(c_acctbal) AS distance FROM customer WHERE abs(c_acctbal) > 0), n AS (SELECT nation, count(*) AS n FROM v GROUP BY 1),
t AS (SELECT nation, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.8::DOUBLE) + (n - i) * ln(0.2::DOUBLE))) AS below FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n), range(0, 5000) r(i) WHERE i < k AND n < 5000 GROUP BY 1, 2, 3),
b AS (SELECT nation, min(k) AS k FROM t WHERE below >= 0.9::DOUBLE AND 1 - 0.8::DOUBLE ** n >= 0.9::DOUBLE GROUP BY 1), o AS (SELECT nation, distance, row_number() OVER (PARTITION BY nation ORDER BY distance) AS k FROM v)
SELECT n.nation, n, q.distance AS quantile, u.distance AS bound FROM n LEFT JOIN o q ON q.nation = n.nation AND q.k = ceil(round(n * 0.8::DOUBLE, 9)) LEFT JOIN (SELECT nation, o.distance FROM b JOIN o USING (nation, k)) u ON u.nation = n.nation""")
def tolerance_bounds(spark, d):
    v = r.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.abs("c_acctbal").alias("distance"))
    return discovery.tolerance_bounds(v, 0.8, 0.9, "nation")


def _swt(source: str, dist: int, out: str) -> str:
    at = lambda dy, dx: f"(a.y + {dy}) % h AND {{0}}.x = (a.x + {dx}) % w"
    return f"""{out} AS (SELECT a.y, a.x, (a.v + r.v + b.v + c.v) / 4 AS ll, (a.v - r.v + b.v - c.v) / 4 AS lh, (a.v + r.v - b.v - c.v) / 4 AS hl, (a.v - r.v - b.v + c.v) / 4 AS hh FROM {source} a, ex, {source} r, {source} b, {source} c
WHERE r.y = {at(0, dist).format('r')} AND b.y = {at(dist, 0).format('b')} AND c.y = {at(dist, dist).format('c')})"""


SWT_SQL = EXTENT_SQL + ", s0 AS (SELECT y, x, value AS v FROM fld), " + _swt("s0", 1, "c1") + ", s1 AS (SELECT y, x, ll AS v FROM c1), " + _swt("s1", 2, "c2") + ", sw AS (SELECT 1 AS level, * FROM c1 UNION ALL SELECT 2, * FROM c2)"


def _stationary(spark, d):
    return discovery.stationary_haar(r.field(spark, d), *r.extent(spark, d), 2)


@queries.add("stationary_haar", r.with_views("fld", more=SWT_SQL) + f"SELECT level, y, x, {', '.join(sql_round(b, digits=8) for b in ('ll', 'lh', 'hl', 'hh'))} FROM sw")
def stationary_haar(spark, d):
    return rounded(_stationary(spark, d), "ll", "lh", "hl", "hh", digits=8)


@queries.add("stationary_haar_inverse", r.with_views("fld", more=SWT_SQL) + f"SELECT y, x, {sql_round('value', digits=5)} FROM fld WHERE (y, x) IN (SELECT (y, x) FROM c2)")
def stationary_haar_inverse(spark, d):
    """Where both levels are complete, the coefficients add up to the field."""
    c = _stationary(spark, d)
    whole = c.where("level = 2").select("y", "x")
    return rounded(discovery.inverse_stationary_haar(c.join(whole, ["y", "x"]), 2), "value", digits=5)


@queries.add("stationary_haar_energies", r.with_views("fld", more=SWT_SQL + ", e AS (SELECT level, lh * lh + hl * hl + hh * hh AS e FROM sw UNION ALL SELECT 0, ll * ll FROM c2), g AS (SELECT level, sum(e) AS energy FROM e GROUP BY 1)") + f"SELECT level, {sql_round('energy', digits=3)}, {sql_round('energy / sum(energy) OVER ()', 'fraction')} FROM g")
def stationary_haar_energies(spark, d):
    return rounded(rounded(discovery.stationary_energies(_stationary(spark, d), 2), "energy", digits=3), "fraction")
