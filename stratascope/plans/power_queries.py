"""Queries over spatial decorrelation and attenuation, and over stable subspaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.folders import stored
from stratascope.operators import spatial_power, subspaces
from stratascope.plans import recasts as r
from stratascope.plans.event_queries import entropy_sql
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
SIDE, LAG, BINS = 16, 2, 3

WEEK = f"({r.DAY.format('l_shipdate')} // 7)"
STACK_SQL = f"""w AS (SELECT {WEEK} AS week, l_suppkey % {SIDE} AS y, l_partkey % {SIDE} AS x, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) / 1000 AS p FROM lineitem GROUP BY 1, 2, 3),
first_ AS (SELECT min(week) AS lo, max(week) - min(week) + 1 AS n FROM w),
cells AS (SELECT f AS frame, y, x FROM first_, range(0, n) a(f), range(0, {SIDE}) b(y), range(0, {SIDE}) c(x)),
st AS MATERIALIZED (SELECT channel, c.frame, c.y, c.x, coalesce(CASE channel WHEN 'source' THEN q ELSE p END, 0.0) AS value FROM cells c CROSS JOIN (SELECT unnest(['source', 'target']) AS channel), first_ LEFT JOIN w ON w.week = c.frame + lo AND w.y = c.y AND w.x = c.x)"""


def stack(spark, d):
    """(channel, frame, y, x, value): what is shipped in a week on a square of suppliers by parts: quantities as the source, prices as the target. Also the number of weeks."""
    week = F.floor(r.day("l_shipdate") / 7).cast("long")
    g = r.read(spark, d, "lineitem").groupBy(week.alias("week"), (F.col("l_suppkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x")).agg(F.sum("l_quantity").alias("source"), (F.round(F.sum("l_extendedprice"), 2) / 1000).alias("target"))
    g = stored(g, "weeks")
    low, high = g.agg(F.min("week"), F.max("week")).first()
    frames = 0 if low is None else high - low + 1
    cells = spark.range(frames * SIDE * SIDE).select((F.col("id") / (SIDE * SIDE)).cast("long").alias("frame"), ((F.col("id") / SIDE).cast("long") % SIDE).alias("y"), (F.col("id") % SIDE).alias("x"))
    own = g.withColumn("frame", F.col("week") - F.lit(low or 0)).drop("week")
    wide = cells.join(own, ["frame", "y", "x"], "left").fillna(0.0, ["source", "target"])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in ("source", "target")])).alias("c")
    return stored(wide.select("frame", "y", "x", each).select("c.channel", "frame", "y", "x", "c.value"), "stack"), frames


def _lengths_sql(source: str, keys: str) -> str:
    """ln: keys, axis, size, decorrelation; ``source`` holds keys, y, x, value of whole squares."""
    k, same = keys, " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
    part = lambda axis, line, at: f"""SELECT {', '.join('a.' + c for c in keys.split(', '))}, '{axis}' AS axis, lag, count(*) AS n, sum(a.v * b.v) AS ab, sum(a.v * a.v) AS aa, sum(b.v * b.v) AS bb FROM ce a JOIN ce b ON {same} AND a.{line} = b.{line} JOIN range(1, {SIDE // 4 + 1}) t(lag) ON b.{at} = a.{at} + lag AND lag <= floor(a.size * 0.25) GROUP BY ALL"""
    return f"""ce AS MATERIALIZED (SELECT *, value - avg(value) OVER (PARTITION BY {k}) AS v, max(y) OVER (PARTITION BY {k}) - min(y) OVER (PARTITION BY {k}) + 1 AS size FROM {source}),
pd AS ({part('row', 'x', 'y')} UNION ALL {part('column', 'y', 'x')}),
hit AS (SELECT {k}, axis, min(lag) AS lag, arg_min(CASE WHEN sqrt(aa * bb) <= 0 THEN 1 ELSE lag END, lag) AS cells FROM pd WHERE n >= 4 AND (sqrt(aa * bb) <= 0 OR abs(ab / sqrt(aa * bb)) < 1 / exp(1)) GROUP BY {k}, axis),
ln AS (SELECT w.*, axis, cells AS decorrelation FROM (SELECT DISTINCT {k}, size FROM ce) w CROSS JOIN (SELECT unnest(['row', 'column']) AS axis) LEFT JOIN hit USING ({k}, axis))"""


@queries.add("spatial_decorrelation", f"WITH {STACK_SQL}, {_lengths_sql('st', 'channel, frame')} SELECT channel, frame, axis, size::INT AS size, decorrelation::INT AS decorrelation, decorrelation IS NULL AS saturated FROM ln")
def spatial_decorrelation(spark, d):
    field, _ = stack(spark, d)
    return spatial_power.decorrelation(spatial_power.products(field, "channel", "frame"), "channel", "frame")


@queries.add("effective_spatial_samples", f"WITH {STACK_SQL}, {_lengths_sql('st', 'channel, frame')}, e AS (SELECT channel, frame, CASE WHEN count(decorrelation) = 2 THEN product(size / decorrelation) END AS effective FROM ln GROUP BY 1, 2) SELECT channel, frame, {sql_round('effective')}, coalesce(effective >= 2, false) AS adequate FROM e")
def effective_spatial_samples(spark, d):
    field, _ = stack(spark, d)
    lengths = spatial_power.decorrelation(spatial_power.products(field, "channel", "frame"), "channel", "frame")
    return rounded(spatial_power.effective_samples(lengths, "channel", "frame"), "effective")


SIZES = spatial_power.crop_sizes(SIDE)
ATTENUATION_SQL = f"""{STACK_SQL}, cr AS MATERIALIZED (SELECT s AS crop, st.* FROM st, (SELECT unnest({SIZES}) AS s) WHERE y >= ({SIDE} - s) // 2 AND y < ({SIDE} - s) // 2 + s AND x >= ({SIDE} - s) // 2 AND x < ({SIDE} - s) // 2 + s),
en AS (SELECT crop, channel, frame, avg(value * value) AS value FROM cr GROUP BY 1, 2, 3), qe AS (SELECT crop, channel, quantile_cont(value, [{', '.join(f'{j}::DOUBLE / {BINS}' for j in range(1, BINS))}]) AS edges FROM en GROUP BY 1, 2),
cd AS (SELECT crop, channel, frame, len([e FOR e IN edges IF e <= value]) AS code FROM en JOIN qe USING (crop, channel)),
lg AS (SELECT s.crop, s.code AS x, p.code AS past, f.code AS future FROM cd s JOIN cd p ON s.crop = p.crop AND s.channel = 'source' AND p.channel = 'target' AND s.frame = p.frame, first_, cd f WHERE f.crop = p.crop AND f.channel = 'target' AND f.frame = (p.frame + {LAG}) % n),
te AS (SELECT crop, greatest(0.0, a.h + b.h - c.h - e.h) AS te FROM {entropy_sql('future, past', 'crop', 'lg')} a JOIN {entropy_sql('x, past', 'crop', 'lg')} b USING (crop) JOIN {entropy_sql('past', 'crop', 'lg')} c USING (crop) JOIN {entropy_sql('future, x, past', 'crop', 'lg')} e USING (crop)),
picked AS (SELECT DISTINCT floor(i * (n - 1)::DOUBLE / (least(16, n) - 1))::BIGINT AS frame FROM first_, range(0, least(16, n)) t(i)), some_ AS (SELECT crop, frame, y, x, value FROM cr JOIN picked USING (frame) WHERE channel = 'source'),
{_lengths_sql('some_', 'crop, frame')}, ef AS (SELECT crop, frame, CASE WHEN count(decorrelation) = 2 THEN product(size / decorrelation) END AS effective FROM ln GROUP BY 1, 2),
md AS (SELECT crop, CASE WHEN 2 * count(effective) > count(*) THEN median(effective) END AS effective FROM ef GROUP BY 1)"""


@queries.add("attenuation_curve", f"WITH {ATTENUATION_SQL} SELECT crop::INT AS crop, {sql_round(f'crop / {SIDE}', 'fraction')}, {sql_round('effective')}, {sql_round('te')} FROM te JOIN md USING (crop)")
def attenuation_curve(spark, d):
    field, frames = stack(spark, d)
    return rounded(spatial_power.attenuation(field, SIDE, SIDE, frames, LAG, BINS), "fraction", "effective", "te")


ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
FEATURES, SPLIT = ("discount", "price", "quantity", "tax"), 2


def samples(spark, d):
    """(half, key, quantity, price, discount, tax, target, nuisance): rows of lineitem; what is paid for one, by the part's size."""
    parts = r.read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("nuisance"), F.col("p_retailprice").alias("price"))
    rows = r.read(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    target = F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount"))
    return rows.select((F.col("l_orderkey") % SPLIT).alias("half"), F.expr(ROW_ID).alias("key"), F.col("l_quantity").alias("quantity"), "price", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), target.alias("target"), "nuisance")


SAMPLES_SQL = f"""sm AS (SELECT l_orderkey % {SPLIT} AS half, {ROW_ID} AS key, l_quantity AS quantity, p_retailprice AS price, l_discount AS discount, l_tax AS tax, l_extendedprice / 1000 * (1 - l_discount) AS target, p_size::DOUBLE AS nuisance FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in (*FEATURES, 'target'))}, quantile_cont(nuisance, [1::DOUBLE / 3, 2::DOUBLE / 3]) AS cuts FROM sm WHERE half = 0),
z AS (SELECT key, (nuisance > cuts[1])::INT + (nuisance > cuts[2])::INT AS region, [{', '.join(f'({c} - m_{c}) / s_{c}' for c in (*FEATURES, 'target'))}] AS v FROM sm, g WHERE half = 0)"""


@queries.add("subspace_moments", f"""WITH {SAMPLES_SQL}, dr AS (SELECT draw, region, [v[1], v[2], v[3], v[4], v[5] * (1 - 2 * (('0x' || substr(md5(concat_ws(':', 7, draw, key)), 1, 12))::BIGINT % 2))] AS v FROM z, range(1, 4) t(draw)),
ij AS (SELECT i, j FROM range(1, 6) a(i), range(1, 6) b(j) WHERE i <= j)
SELECT draw::INT AS draw, region, count(*) AS n, (i - 1)::INT AS i, (j - 1)::INT AS j, {sql_round('sum(v[i] * v[j])', 'product', 4)} FROM dr, ij GROUP BY draw, region, i, j""")
def subspace_moments(spark, d):
    """The sums of the first null draws: products of scores by region and draw."""
    from itertools import combinations_with_replacement

    rows = samples(spark, d).where("half = 0")
    s = subspaces.scores_of(rows, FEATURES, "target", "nuisance")
    m = subspaces.moments(subspaces.signed(subspaces.scored(rows, s, F.col("key")), 3, 7), len(FEATURES), "draw", "region")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations_with_replacement(range(len(FEATURES) + 1), 2)])
    return rounded(m.select("draw", "region", "n", F.explode(F.arrays_zip(cells.alias("at"), "products")).alias("c")).select("draw", "region", "n", "c.at.i", "c.at.j", F.col("c.products").alias("product")), "product", digits=4)


@queries.add("stable_subspaces")
def stable_subspaces(spark, d):
    """Spans found on the orders of even number and confirmed on the others."""
    rows = stored(samples(spark, d), "samples")
    recipe = subspaces.Recipe(dimensions=(1, 2), ridges=(0.1, 1.0), draws=199)
    half, key = rows.where("half = 0"), F.col("key")
    s = subspaces.scores_of(half, FEATURES, "target", "nuisance")
    spans = subspaces.generated(half, s, key, recipe)
    again = subspaces.confirmed(rows.where("half = 1"), spans, s, key, recipe)
    found = spans.select("label", F.col("explained").alias("found_explained"), F.col("q").alias("found_q"), "farthest")
    return rounded(again.join(found, "label").select("label", "found_explained", "found_q", "farthest", "candidate", "explained", "q", "region_range", "replicated"), "found_explained", "found_q", "farthest", "explained", "q", "region_range")
