"""Queries over sources, kernels and streams; with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import shared_folder
from stratascope.operators import grids, kernels
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round
from stratascope.sources import catalogue, delimited
from stratascope.streaming import streams

queries = Registry()
PROBED = ["p_partkey", "p_brand", "p_size", "p_retailprice"]


@queries.add("csv_probe_facts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS \"distinct\", {'false' if c == 'p_brand' else 'true'} AS numeric, {'NULL::DOUBLE' if c == 'p_brand' else f'min({c})::DOUBLE'} AS low, {'NULL::DOUBLE' if c == 'p_brand' else f'max({c})::DOUBLE'} AS high FROM part" for c in PROBED))
def csv_probe_facts(spark, d):
    return delimited.probe(r.read(spark, d, "part"), PROBED)


@queries.add("monthly_shards", """WITH g AS (SELECT o_orderpriority AS name, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1), m AS (SELECT name, s, e, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH))::DATE AS month FROM g)
SELECT name, strftime(month, '%Y-%m-%d') AS month, strftime(greatest(month, s), '%Y-%m-%d') AS first, strftime(least(last_day(month), e), '%Y-%m-%d') AS last FROM m""")
def monthly_shards(spark, d):
    ranges = r.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end"))
    out = catalogue.monthly_shards(ranges)
    return out.select("name", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("month", "first", "last")])


@queries.add("content_blocks", """WITH h AS (SELECT c_custkey % 16 AS block, c_custkey AS k, sha256(concat_ws('|', c_custkey::VARCHAR, coalesce(c_name, ''), coalesce(c_mktsegment, ''))) AS h FROM customer)
SELECT block, count(*) AS n, sha256(string_agg(h, '' ORDER BY k)) AS sha256 FROM h GROUP BY 1""")
def content_blocks(spark, d):
    return catalogue.content_blocks(r.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 16)


def _daily_field(spark, d):
    """(frame, y, x, value): a day's summed values by event type and quarter; quarters without events are missing."""
    kind = F.dense_rank().over(Window.orderBy("channel")) - 1
    names = r.channels(spark, d).select("channel").distinct().withColumn("y", kind)
    return r.channels(spark, d).join(F.broadcast(names), "channel").select(F.floor(F.col("frame") / 24).alias("frame"), "y", F.floor(F.col("frame") % 24 / 6).alias("x"), "value").groupBy("frame", "y", "x").agg(F.round(F.sum("value"), 4).alias("value"))


DAY_SQL = "k AS (SELECT channel, dense_rank() OVER (ORDER BY channel) - 1 AS y FROM (SELECT DISTINCT channel FROM ch)), dy AS (SELECT frame // 24 AS frame, y, frame % 24 // 6 AS x, round(sum(value), 4) AS value FROM ch JOIN k USING (channel) GROUP BY 1, 2, 3), full_ AS (SELECT frame FROM dy GROUP BY 1 HAVING count(value) = 20)"


@queries.add("fft_power_total", r.with_views("ch", more=DAY_SQL) + f"SELECT frame, {sql_round('sum(value * value) / 20', 'power', 4)} FROM dy JOIN full_ USING (frame) GROUP BY 1")
def fft_power_total(spark, d):
    """Parseval: the rings of the radial spectrum hold the frame's mean square."""
    rings = kernels.radial_spectrum(_daily_field(spark, d), 5, 4)
    return rounded(rings.groupBy("frame").agg(F.sum(F.col("n") * F.col("power")).alias("power")), "power", digits=4)


@queries.add("radial_spectrum")
def radial_spectrum(spark, d):
    return rounded(kernels.radial_spectrum(_daily_field(spark, d), 5, 4), "power")


@queries.add("cosine_energy", r.with_views("ch", more=DAY_SQL) + f"SELECT frame, {sql_round('sum(value * value)', 'total', 4)} FROM dy JOIN full_ USING (frame) GROUP BY 1")
def cosine_energy(spark, d):
    return rounded(kernels.cosine_energies(_daily_field(spark, d), 5, 4).select("frame", "total"), "total", digits=4)


@queries.add("stationary_wavelet_energy", r.with_views("ch") + f"SELECT channel, {sql_round('sum(value * value)', 'energy', 3)} FROM ch GROUP BY 1")
def stationary_wavelet_energy(spark, d):
    """The levels' energies, each less its gain, add up to the series' own."""
    e = kernels.stationary_energies(r.channels(spark, d), 3)
    return rounded(e.groupBy("channel").agg(F.sum("energy").alias("energy")), "energy", digits=3)


@queries.add("surrogate_moments", r.with_views("ch") + f"SELECT channel, draw::INT AS draw, {sql_round('avg(value)', 'mean', 4)}, {sql_round('sum(value * value)', 'square', 2)} FROM ch, range(1, 4) t(draw) GROUP BY 1, 2")
def surrogate_moments(spark, d):
    """Random phases keep a series' mean and sum of squares."""
    s = kernels.surrogates(r.channels(spark, d), 3, 7)
    out = s.groupBy("channel", "draw").agg(F.avg("value").alias("mean"), F.sum(F.col("value") * F.col("value")).alias("square"))
    return rounded(rounded(out, "mean", digits=4), "square", digits=2)


@queries.add("tracked_features")
def tracked_features(spark, d):
    """The three largest cells of each month and half of the nations, followed over months."""
    f = r.field(spark, d).select((F.col("x") % 2).alias("series"), F.col("y").alias("frame"), F.floor(F.col("x") / 5).cast("double").alias("y"), (F.col("x") % 5).cast("double").alias("x"), "value")
    return kernels.tracks(grids.top_features(f, 3, "series", "frame").drop("value", "rank"), 1.5)


@queries.add("linked_clusters")
def linked_clusters(spark, d):
    """Customers of one nation and segment, by balance and age of their number."""
    c = r.read(spark, d, "customer")
    v = c.select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("group"), F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_custkey") / 1000.0).alias("v"))
    return kernels.clusters(v, "group", 1.2)


@queries.add("principal_axes", f"WITH {r.SQL['smp']}, c AS (SELECT corr(quantity, target) AS r FROM smp) SELECT k::INT AS axis, {sql_round('CASE k WHEN 0 THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END', 'explained')} FROM c, range(0, 2) t(k)")
def principal_axes(spark, d):
    return rounded(kernels.principal_axes(r.samples(spark, d), ["quantity", "target"]).select("axis", "explained"), "explained")


@queries.add("streaming_hourly_counts", f"SELECT {r.HOUR.format('ts')} AS hour, event_type, count(*) AS n, {sql_round('sum(value)', 'total', 4)} FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def streaming_hourly_counts(spark, d):
    table = streams.run_once(streams.hourly_counts(streams.event_stream(spark, d)), shared_folder(spark))
    return rounded(streams.newest(table, "hour", "event_type"), "total", digits=4)


@queries.add("streaming_latest", "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS detail FROM events GROUP BY 1")
def streaming_latest(spark, d):
    table = streams.run_once(streams.latest_by_key(streams.event_stream(spark, d), "user_id", "event_id", "event_type"), shared_folder(spark))
    return streams.newest(table, "user_id")
