"""Queries over ranked rules, declared axes, presence and pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import events, search
from stratascope.plans import recasts as r
from stratascope.plans.event_queries import CORR_SQL, COUNTS_SQL, LAGS, R1_SQL
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()


def _rules(spark, d):
    s = r.series(spark, d)
    return rounded(events.precursor_counts(s, events.observed_frames(s), LAGS), "confidence", "lift")


RULES_SQL = COUNTS_SQL + f", rules AS (SELECT antecedent, consequent, lo::BIGINT AS lo, hi::BIGINT AS hi, support, {sql_round('confidence')}, {sql_round('CASE WHEN base_rate > 0 THEN confidence / base_rate END', 'lift')} FROM counts)"


@queries.add("bidirectional_query", r.with_views("ev", more=RULES_SQL) + "SELECT consequent, antecedent, lo, hi, " + ", ".join(f"(rank() OVER (PARTITION BY consequent ORDER BY {k} DESC NULLS LAST))::INT AS rank_{k}" for k in ("lift", "confidence", "support")) + " FROM rules")
def bidirectional_query(spark, d):
    """What comes before each pattern, ranked by each figure."""
    return search.ranked_by_each(_rules(spark, d), "consequent", ["lift", "confidence", "support"]).select("consequent", "antecedent", "lo", "hi", "rank_lift", "rank_confidence", "rank_support")


@queries.add("directional_pairs", r.with_views("ev", more=RULES_SQL) + "SELECT coalesce(t.antecedent, b.consequent) AS a, coalesce(t.consequent, b.antecedent) AS b, coalesce(t.lo, b.lo) AS lo, coalesce(t.hi, b.hi) AS hi, t.support AS support_there, t.lift AS lift_there, b.support AS support_back, b.lift AS lift_back FROM (SELECT * FROM rules WHERE antecedent < consequent) t FULL JOIN (SELECT * FROM rules WHERE antecedent > consequent) b ON t.antecedent = b.consequent AND t.consequent = b.antecedent AND t.lo = b.lo AND t.hi = b.hi")
def directional_pairs(spark, d):
    return search.directional_pairs(_rules(spark, d), ["support", "lift"])


BEST_SQL = CORR_SQL + ", " + R1_SQL + """, sr AS (SELECT driver, driven, lag, round(abs(r), 9) AS strength, greatest(3.0, cc.n * (1 - least(greatest(a.r1 * b.r1, -0.999), 0.999)) / (1 + least(greatest(a.r1 * b.r1, -0.999), 0.999))) AS ne FROM cc JOIN r1 a ON a.channel = driver JOIN r1 b ON b.channel = driven),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver, driven ORDER BY strength DESC, lag) AS place FROM sr) WHERE place = 1), best AS (SELECT strength AS top, ne AS top_ne FROM s ORDER BY strength DESC, ne DESC LIMIT 1),
near AS (SELECT driver, driven, lag, strength FROM s, best WHERE atanh(least(top, 0.999999::DOUBLE)) - atanh(least(strength, 0.999999::DOUBLE)) <= 1 / sqrt(greatest(4.0, top_ne) - 3))"""


def _near_best(spark, d):
    from stratascope.operators import clocks

    record = r.channels(spark, d)
    s = clocks.lagged_correlations(record, list(range(7))).select("driver", "driven", "lag", "n", F.round(F.abs("r"), 9).alias("strength"))
    own = clocks.lag_one(record, "channel")
    side = lambda name: F.broadcast(own.select(F.col("channel").alias(name), F.col("r1").alias(f"r_{name}")))  # noqa: E731  a row a channel
    product = F.least(F.greatest(F.col("r_driver") * F.col("r_driven"), F.lit(-0.999)), F.lit(0.999))
    s = s.join(side("driver"), "driver").join(side("driven"), "driven").withColumn("n_effective", F.greatest(F.lit(3.0), F.col("n") * (1 - product) / (1 + product)))
    best = search.best_of_pairs(s.select("driver", "driven", "lag", "strength", "n_effective"), "strength", ["lag"], "driver", "driven")
    return search.indistinguishable(best, "strength", "n_effective").select("driver", "driven", "lag", "strength")


@queries.add("indistinguishable_from_best", r.with_views("ch", more=BEST_SQL) + f"SELECT driver, driven, lag, {sql_round('strength')} FROM near")
def indistinguishable_from_best(spark, d):
    return rounded(_near_best(spark, d), "strength")


@queries.add("chosen_candidates", r.with_views("ch", more=BEST_SQL + ", c AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY strength DESC, driven, lag) AS i FROM near)") + f"SELECT driver, driven, lag, {sql_round('strength')} FROM c WHERE i <= 2")
def chosen_candidates(spark, d):
    return rounded(search.chosen(_near_best(spark, d), [F.desc("strength"), F.asc("driven"), F.asc("lag")], 2, "driver"), "strength")


WORDS = ["the", "license", "version", "public", "table"]


@queries.add("records_by_overlap", f"SELECT doc_id, score FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')), {WORDS}))::BIGINT AS score FROM documents) ORDER BY doc_id = 17 DESC, score DESC, doc_id LIMIT 8")
def records_by_overlap(spark, d):
    return search.records_by_overlap(r.read(spark, d, "documents"), "text", WORDS, "doc_id", 17)


@queries.add("latest_outcomes", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def latest_outcomes(spark, d):
    return search.latest(r.read(spark, d, "events").where("user_id IS NOT NULL"), "value", ["ts", "event_id"], "user_id", "event_type")


@queries.add("overlapping_windows", r.with_views("uev", more="g AS (SELECT pattern, frame - lag(frame) OVER (PARTITION BY pattern ORDER BY frame) AS gap FROM uev)") + "SELECT pattern, count(*) AS n, count(*) FILTER (gap < 6) AS overlapping FROM g GROUP BY 1")
def overlapping_windows(spark, d):
    return search.overlapping(r.user_series(spark, d), 6, "pattern")


PRESENCE_SQL = f"days AS (SELECT DISTINCT user_id, {r.DAY.format('ts')} AS day FROM events WHERE user_id IS NOT NULL), s AS (SELECT count(DISTINCT day) AS scenes FROM days), c AS (SELECT present, count(*) AS configurations FROM (SELECT user_id, count(*) AS present FROM days GROUP BY 1) GROUP BY 1), pd AS (SELECT p.present, coalesce(configurations, 0) AS configurations FROM (SELECT unnest(range(0, scenes + 1)) AS present FROM s) p LEFT JOIN c USING (present))"


def _presence(spark, d):
    days = r.read(spark, d, "events").where("user_id IS NOT NULL").select("user_id", r.day("ts").alias("day"))
    scenes = days.select("day").distinct().count()
    return search.presence(days, "user_id", "day", scenes), scenes


@queries.add("presence_distribution", f"WITH {PRESENCE_SQL} SELECT present, configurations FROM pd")
def presence_distribution(spark, d):
    return _presence(spark, d)[0]


@queries.add("admission_rates", f"WITH {PRESENCE_SQL} SELECT absences, {sql_round('sum(CASE WHEN present >= scenes - absences THEN configurations ELSE 0 END) / sum(configurations)', 'rate')} FROM pd, s, (SELECT unnest([0, 2, 5, 10, 20])::BIGINT AS absences) GROUP BY 1")
def admission_rates(spark, d):
    found, scenes = _presence(spark, d)
    return rounded(search.admission_rates(found, scenes, [0, 2, 5, 10, 20]), "rate")


@queries.add("verdict_travel", r.with_views("ev", more=RULES_SQL) + "SELECT lo, hi, count(*) AS n, count(*) FILTER (lift >= 1.05::DOUBLE AND NOT lift >= 1.0) AS gained, count(*) FILTER (lift >= 1.0 AND NOT lift >= 1.05::DOUBLE) AS lost FROM rules GROUP BY 1, 2")
def verdict_travel(spark, d):
    return search.verdict_travel(_rules(spark, d), "lift", 1.0, 1.05, "lo", "hi")


@queries.add("pool_spread", f"SELECT c_nationkey AS nation, count(c_acctbal) AS n, min(c_acctbal) AS low, {sql_round('median(c_acctbal)', 'middle')}, max(c_acctbal) AS high, {sql_round('avg((c_acctbal <= 1000)::INT)', 'percentile')} FROM customer GROUP BY 1")
def pool_spread(spark, d):
    return rounded(search.spread(r.read(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "c_acctbal", F.lit(1000), "nation"), "middle", "percentile")


@queries.add("nearest_summary", "SELECT nation, count(*) AS n, min(v) AS low, max(v) FILTER (i = m // 2) AS upper_median, max(v) AS high, count(*) FILTER (v <= 2500) AS inside, count(*) // 2 + 1 AS majority FROM (SELECT c_nationkey AS nation, abs(c_acctbal) AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal)) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer) GROUP BY 1")
def nearest_summary(spark, d):
    rows = r.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.abs("c_acctbal").alias("v"))
    return search.nearest_summary(rows, "v", 2500, "nation")


@queries.add("parameter_grid", "SELECT flag, status, priority FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem), (SELECT DISTINCT l_linestatus AS status FROM lineitem), (SELECT DISTINCT o_orderpriority AS priority FROM orders)")
def parameter_grid(spark, d):
    lines, orders = r.read(spark, d, "lineitem"), r.read(spark, d, "orders")
    return search.parameter_grid(lines.select(F.col("l_returnflag").alias("flag")).distinct(), lines.select(F.col("l_linestatus").alias("status")).distinct(), orders.select(F.col("o_orderpriority").alias("priority")).distinct())


TYPES_SQL = "t AS (SELECT DISTINCT event_type AS v FROM events WHERE event_type IS NOT NULL)"


def _types(spark, d):
    return r.read(spark, d, "events").where("event_type IS NOT NULL").select(F.col("event_type").alias("v")).distinct()


@queries.add("axis_pairs", f"WITH {TYPES_SQL} SELECT a.v AS first, b.v AS second, a.v < b.v AS unordered FROM t a, t b WHERE a.v <> b.v")
def axis_pairs(spark, d):
    types = _types(spark, d)
    both = search.axis_pairs(types, "v", ordered=True)
    return both.join(search.axis_pairs(types, "v", ordered=False).withColumn("unordered", F.lit(True)), ["first", "second"], "left").fillna(False, ["unordered"])


@queries.add("domain_set_labels", f"WITH {TYPES_SQL} SELECT 2::BIGINT AS arity, a.v || '+' || b.v AS labels FROM t a, t b WHERE a.v < b.v UNION ALL SELECT 3, a.v || '+' || b.v || '+' || c.v FROM t a, t b, t c WHERE a.v < b.v AND b.v < c.v")
def domain_set_labels(spark, d):
    return search.label_sets(_types(spark, d), "v", [2, 3])


@queries.add("cross_domain_pairs", f"WITH {TYPES_SQL}, c AS (SELECT 'events' AS domain, v AS channel FROM t UNION ALL SELECT DISTINCT 'orders', o_orderpriority FROM orders) SELECT a.domain AS driver_domain, a.channel AS driver, b.domain AS driven_domain, b.channel AS driven FROM c a, c b WHERE a.domain <> b.domain")
def cross_domain_pairs(spark, d):
    priorities = r.read(spark, d, "orders").select(F.lit("orders").alias("domain"), F.col("o_orderpriority").alias("channel")).distinct()
    return search.cross_domain_pairs(_types(spark, d).select(F.lit("events").alias("domain"), F.col("v").alias("channel")).unionByName(priorities))


@queries.add("excluded_targets", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def excluded_targets(spark, d):
    return r.read(spark, d, "customer").join(r.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@queries.add("coverage_report", "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'unplanted' WHEN b.user_id IS NULL THEN 'missed' ELSE 'recovered' END AS status FROM (SELECT DISTINCT user_id FROM events WHERE value > 90) a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE value < 5) b ON a.user_id = b.user_id")
def coverage_report(spark, d):
    e = r.read(spark, d, "events")
    return search.coverage(e.where("value > 90"), e.where("value < 5"), "user_id")


@queries.add("merged_parts", "SELECT kind, count(*) AS n, max(key) AS largest FROM (SELECT 'customer' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY 1")
def merged_parts(spark, d):
    a, b = r.read(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")), r.read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return search.merged([a, b], "kind", "key").groupBy("kind").agg(F.count("*").alias("n"), F.max("key").alias("largest"))


@queries.add("flattened_props", "SELECT event_id, k AS path, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def flattened_props(spark, d):
    return search.flattened(r.read(spark, d, "events"), "props", "event_id")


@queries.add("linked_selection", f"SELECT domain, count(*) AS n, {sql_round('sum(v)', 'total', 2)} FROM (SELECT 'orders' AS domain, o_orderdate AS t, o_totalprice AS v FROM orders UNION ALL SELECT 'lines', l_shipdate, l_extendedprice FROM lineitem UNION ALL SELECT 'events', ts, value FROM events) WHERE t >= TIMESTAMP '1998-01-01' AND t < TIMESTAMP '2024-01-15' GROUP BY 1")
def linked_selection(spark, d):
    """One window's own values in each domain."""
    parts = [("orders", "orders", "o_orderdate", "o_totalprice"), ("lines", "lineitem", "l_shipdate", "l_extendedprice"), ("events", "events", "ts", "value")]
    rows = [r.read(spark, d, name).select(F.lit(domain).alias("domain"), F.col(t).cast("timestamp_ntz").alias("t"), F.col(v).alias("v")) for domain, name, t, v in parts]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("t >= TIMESTAMP_NTZ '1998-01-01' AND t < TIMESTAMP_NTZ '2024-01-15'")
    return rounded(every.groupBy("domain").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", digits=2)
