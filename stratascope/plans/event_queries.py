"""Queries over event series and channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import clocks, dependence, events, testing
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
LAGS = ((1, 1), (1, 3), (2, 6))
WINDOWS_SQL = """grid AS (SELECT DISTINCT frame FROM ev), ends AS (SELECT min(frame) AS f, max(frame) AS l FROM grid),
lags AS (SELECT * FROM (VALUES (1, 1), (1, 3), (2, 6)) v(lo, hi)),
status AS (SELECT lo, hi, g.frame, CASE WHEN g.frame + lo < f OR g.frame + hi > l THEN 'TRUNCATED'
  WHEN (SELECT count(*) FROM grid h WHERE h.frame BETWEEN g.frame + lo AND g.frame + hi) < hi - lo + 1 THEN 'INCOMPLETE' ELSE 'MEASURED' END AS status FROM grid g, lags, ends),
hits AS (SELECT DISTINCT lo, hi, pattern, g.frame FROM grid g, lags JOIN ev ON ev.frame BETWEEN g.frame + lo AND g.frame + hi),
base AS (SELECT m.lo, m.hi, p.pattern AS consequent, count(*) AS positions, count(h.pattern) AS hits, count(h.pattern) / count(*) AS base_rate
  FROM (SELECT * FROM status WHERE status = 'MEASURED') m CROSS JOIN (SELECT DISTINCT pattern FROM ev) p
  LEFT JOIN hits h ON h.lo = m.lo AND h.hi = m.hi AND h.frame = m.frame AND h.pattern = p.pattern GROUP BY 1, 2, 3)"""
COUNTS_SQL = WINDOWS_SQL + """,
totals AS (SELECT s.lo, s.hi, e.pattern AS antecedent, count(*) AS anchors, count(*) FILTER (status = 'MEASURED') AS eligible FROM ev e JOIN status s USING (frame) GROUP BY 1, 2, 3),
support AS (SELECT s.lo, s.hi, e.pattern AS antecedent, h.pattern AS consequent, count(*) AS support FROM ev e JOIN status s USING (frame)
  JOIN hits h ON h.lo = s.lo AND h.hi = s.hi AND h.frame = e.frame WHERE status = 'MEASURED' GROUP BY 1, 2, 3, 4),
counts AS (SELECT t.antecedent, b.consequent, t.lo, t.hi, t.anchors, t.eligible, coalesce(s.support, 0) AS support,
  CASE WHEN t.eligible > 0 THEN coalesce(s.support, 0) / t.eligible END AS confidence, b.base_rate
  FROM totals t JOIN base b ON t.lo = b.lo AND t.hi = b.hi AND t.antecedent <> b.consequent
  LEFT JOIN support s ON s.lo = t.lo AND s.hi = t.hi AND s.antecedent = t.antecedent AND s.consequent = b.consequent)"""


def _counts(spark, d):
    s = r.series(spark, d)
    return events.precursor_counts(s, events.observed_frames(s), LAGS)


@queries.add("precursor_counts", r.with_views("ev", more=COUNTS_SQL) + f"SELECT antecedent, consequent, lo::BIGINT AS lo, hi::BIGINT AS hi, anchors, eligible, support, {sql_round('confidence')}, {sql_round('base_rate')}, {sql_round('CASE WHEN base_rate > 0 THEN confidence / base_rate END', 'lift')} FROM counts")
def precursor_counts(spark, d):
    return rounded(_counts(spark, d), "confidence", "base_rate", "lift")


@queries.add("window_base_rates", r.with_views("ev", more=WINDOWS_SQL) + f"SELECT lo::BIGINT AS lo, hi::BIGINT AS hi, consequent, positions, hits, {sql_round('base_rate')} FROM base")
def window_base_rates(spark, d):
    s = r.series(spark, d)
    return rounded(events.base_rates(s, events.observed_frames(s), LAGS), "base_rate")


@queries.add("window_status_counts", r.with_views("ev", more=WINDOWS_SQL) + "SELECT lo::BIGINT AS lo, hi::BIGINT AS hi, status, count(*) AS n FROM status GROUP BY ALL")
def window_status_counts(spark, d):
    return events.window_status(events.observed_frames(r.series(spark, d)), LAGS).groupBy("lo", "hi", "status").agg(F.count("*").alias("n"))


@queries.add("wilson_intervals", r.with_views("ev", more=COUNTS_SQL) + f"""SELECT antecedent, consequent, lo::BIGINT AS lo, hi::BIGINT AS hi,
{sql_round('CASE WHEN eligible > 0 THEN (confidence + zz / (2 * eligible) - z * sqrt(confidence * (1 - confidence) / eligible + zz / (4 * eligible * eligible))) / (1 + zz / eligible) END', 'lower')},
{sql_round('CASE WHEN eligible > 0 THEN (confidence + zz / (2 * eligible) + z * sqrt(confidence * (1 - confidence) / eligible + zz / (4 * eligible * eligible))) / (1 + zz / eligible) END', 'upper')}
FROM counts, (SELECT 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054 AS zz)""")
def wilson_intervals(spark, d):
    low, high = testing.wilson(F.col("support"), F.col("eligible"))
    return rounded(_counts(spark, d).select("antecedent", "consequent", "lo", "hi", low.alias("lower"), high.alias("upper")), "lower", "upper")


NULL_SQL = """grid AS (SELECT DISTINCT frame FROM ev), ends AS (SELECT min(frame) AS f, max(frame) AS l, max(frame) - min(frame) + 1 AS n FROM grid),
few AS (SELECT pattern, frame FROM ev),
measured AS (SELECT frame FROM grid g, ends WHERE frame + 3 <= l AND (SELECT count(*) FROM grid h WHERE h.frame BETWEEN g.frame + 1 AND g.frame + 3) = 3),
hits AS (SELECT DISTINCT pattern AS consequent, m.frame FROM measured m JOIN few e ON e.frame BETWEEN m.frame + 1 AND m.frame + 3),
observed AS (SELECT e.pattern AS antecedent, consequent, count(*) AS observed FROM few e JOIN hits h USING (frame) WHERE pattern <> consequent GROUP BY 1, 2),
shifts AS (SELECT unnest(range(24, n - 24 + 1)) AS shift FROM ends),
moved AS (SELECT pattern AS antecedent, shift, f + (frame - f + shift) % n AS frame FROM few, shifts, ends),
sup AS (SELECT antecedent, consequent, shift, count(*) AS support FROM moved JOIN hits USING (frame) WHERE antecedent <> consequent GROUP BY 1, 2, 3),
reach AS (SELECT antecedent, consequent, count(*) FILTER (support >= observed) AS reached FROM sup JOIN observed USING (antecedent, consequent) GROUP BY 1, 2),
tests AS (SELECT antecedent, consequent, observed, n + 1 - 2 * 24 AS draws, coalesce(reached, 0) AS reached, (1 + coalesce(reached, 0)) / (1 + (n + 1 - 2 * 24)) AS p_value, antecedent || '>' || consequent AS test
  FROM observed LEFT JOIN reach USING (antecedent, consequent), ends)"""


def _null(spark, d):
    s = r.series(spark, d)
    return events.exact_null(s, events.observed_frames(s), 1, 3, 24).withColumn("test", F.concat_ws(">", "antecedent", "consequent"))


@queries.add("precursor_exact_null", r.with_views("ev", more=NULL_SQL) + f"SELECT antecedent, consequent, observed, draws, reached, {sql_round('p_value')} FROM tests")
def precursor_exact_null(spark, d):
    return rounded(_null(spark, d).drop("test"), "p_value")


@queries.add("adjusted_family", r.with_views("ev", more=NULL_SQL + """,
size AS (SELECT count(DISTINCT pattern) * (count(DISTINCT pattern) - 1) AS m FROM ev), ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS i FROM tests)""") + f"""SELECT test, {sql_round('least(1.0, p_value * m)', 'bonferroni')},
{sql_round('least(1.0, max(p_value * (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))', 'holm')},
{sql_round('least(1.0, min(p_value * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'bh')},
{sql_round('least(1.0, min(p_value * m * harmonic / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'by')} FROM ranked, size, (SELECT sum(1.0::DOUBLE / k) AS harmonic FROM size, range(1, m + 1) t(k))""")
def adjusted_family(spark, d):
    """The family is all ordered pairs of patterns, whether or not a pair ever occurs."""
    patterns = r.series(spark, d).select("pattern").distinct().count()
    return rounded(testing.adjust(_null(spark, d).select("test", "p_value"), patterns * (patterns - 1)).drop("p_value"), "bonferroni", "holm", "bh", "by")


@queries.add("p_uniformity", r.with_views("ev", more=NULL_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY antecedent ORDER BY p_value) AS i, count(*) OVER (PARTITION BY antecedent) AS m FROM tests)""") + f"SELECT antecedent, count(*) AS n, {sql_round('max(greatest(i / m - p_value, p_value - (i - 1) / m))', 'ks')} FROM ranked GROUP BY 1")
def p_uniformity(spark, d):
    return rounded(testing.uniformity(_null(spark, d), "antecedent"), "ks")


@queries.add("recurrence_modal_gap", r.with_views("uev", more="""gaps AS (SELECT pattern, frame - lag(frame) OVER (PARTITION BY pattern ORDER BY frame) AS gap FROM uev),
n AS (SELECT pattern, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2),
best AS (SELECT *, sum(n) OVER (PARTITION BY pattern)::BIGINT AS measured, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, gap) AS i FROM n)""") + f"SELECT pattern, measured, gap AS modal_gap, n AS modal_count, {sql_round('n / measured', 'concentration')} FROM best WHERE i = 1 AND measured >= 2 AND n >= 2")
def recurrence_modal_gap(spark, d):
    return rounded(events.recurrence(r.user_series(spark, d)), "concentration")


@queries.add("frequent_chains", r.with_views("ev", more="""few AS (SELECT pattern, frame FROM ev), grid AS (SELECT DISTINCT frame FROM ev), l AS (SELECT max(frame) AS l FROM grid),
m2 AS (SELECT frame FROM grid g, l WHERE frame + 2 <= l AND (SELECT count(*) FROM grid h WHERE h.frame BETWEEN g.frame + 1 AND g.frame + 2) = 2),
m3 AS (SELECT frame FROM grid g, l WHERE frame + 4 <= l AND (SELECT count(*) FROM grid h WHERE h.frame BETWEEN g.frame + 1 AND g.frame + 4) = 4),
r2 AS (SELECT DISTINCT a.pattern || '>' || b.pattern AS chain, a.pattern AS first, a.frame AS anchor, b.frame AS at FROM few a JOIN few b ON b.frame BETWEEN a.frame + 1 AND a.frame + 2),
s2 AS (SELECT chain, first, count(DISTINCT anchor) AS support FROM r2 JOIN m2 ON anchor = m2.frame GROUP BY 1, 2),
r3 AS (SELECT DISTINCT r2.chain || '>' || b.pattern AS chain, first, anchor FROM r2 JOIN few b ON b.frame BETWEEN r2.at + 1 AND r2.at + 2 WHERE r2.chain IN (SELECT chain FROM s2 WHERE support >= 5)),
s3 AS (SELECT chain, first, count(DISTINCT anchor) AS support FROM r3 JOIN m3 ON anchor = m3.frame GROUP BY 1, 2),
e AS (SELECT pattern AS first, 2 AS length, count(*) AS eligible FROM few JOIN m2 USING (frame) GROUP BY 1 UNION ALL SELECT pattern, 3, count(*) FROM few JOIN m3 USING (frame) GROUP BY 1)""") + f"SELECT chain, length, eligible, support, {sql_round('support / eligible', 'confidence')} FROM (SELECT *, 2 AS length FROM s2 UNION ALL SELECT *, 3 FROM s3) JOIN e USING (first, length)")
def frequent_chains(spark, d):
    s = r.series(spark, d)
    return rounded(events.chain_support(s, events.observed_frames(s), 3, 1, 2, 5), "confidence")


@queries.add("cooccurrence_frames", r.with_views("ev") + "SELECT frame, string_agg(pattern, '+' ORDER BY pattern) AS patterns FROM ev GROUP BY 1 HAVING count(*) > 1")
def cooccurrence_frames(spark, d):
    return events.co_occurrences(r.series(spark, d))


@queries.add("ranked_rules", r.with_views("ev", more=COUNTS_SQL) + "SELECT consequent, antecedent, lo::BIGINT AS lo, hi::BIGINT AS hi, (row_number() OVER (PARTITION BY consequent ORDER BY support DESC NULLS LAST, antecedent, lo, hi))::INT AS rank FROM counts")
def ranked_rules(spark, d):
    return events.ranked_rules(_counts(spark, d), "support").select("consequent", "antecedent", "lo", "hi", "rank")


@queries.add("scale_ordering", f"SELECT event_type AS pattern, {sql_round('min(value)', 'low')}, {sql_round('max(value)', 'high')}, {sql_round('exp(avg(ln(value)))', 'middle')} FROM events WHERE value > 0 AND event_type IS NOT NULL GROUP BY 1")
def scale_ordering(spark, d):
    return rounded(events.scale_order(r.read(spark, d, "events").where("event_type IS NOT NULL").select(F.col("event_type").alias("pattern"), F.col("value").alias("scale"))), "low", "high", "middle")


# Clocks and channels


@queries.add("clock_facts", r.with_views("dl", more="st AS (SELECT *, day - lag(day) OVER (PARTITION BY supplier ORDER BY day) AS step FROM dl)") + "SELECT supplier, count(*) AS n, min(step) AS least_step, max(step) AS most_step, quantile_cont(step, 0.5)::DOUBLE AS median_step, count(*) FILTER (step = 0) AS repeated, coalesce(min(step) = max(step), false) AS regular FROM st GROUP BY 1")
def clock_facts(spark, d):
    return clocks.clock_facts(r.dealings(spark, d).withColumnRenamed("day", "time"), "supplier")


@queries.add("cadence_record", r.with_views("dl", more="st AS (SELECT *, day - lag(day) OVER (PARTITION BY supplier ORDER BY day) AS step FROM dl)") + "SELECT supplier, step, count(*) AS n, step = 1 AS as_expected FROM st WHERE step IS NOT NULL GROUP BY 1, 2")
def cadence_record(spark, d):
    return clocks.cadence_record(r.dealings(spark, d).withColumnRenamed("day", "time"), 1, "supplier")


def _days(spark, d):
    o = r.read(spark, d, "orders").groupBy(r.day("o_orderdate").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    l = r.read(spark, d, "lineitem").groupBy(r.day("l_shipdate").alias("time")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return o, l


DAYS_SQL = f"od AS (SELECT {r.DAY.format('o_orderdate')} AS time, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1), ld AS (SELECT {r.DAY.format('l_shipdate')} AS time, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1)"


@queries.add("align_exact", f"WITH {DAYS_SQL} SELECT time, od.value AS a, ld.value AS b FROM od JOIN ld USING (time)")
def align_exact(spark, d):
    return clocks.align_exact(*_days(spark, d))


@queries.add("alignment_report", f"WITH {DAYS_SQL} SELECT count(*) FILTER (od.time IS NOT NULL AND ld.time IS NOT NULL) AS shared, count(*) FILTER (ld.time IS NULL) AS only_first, count(*) FILTER (od.time IS NULL) AS only_second FROM od FULL JOIN ld ON od.time = ld.time")
def alignment_report(spark, d):
    return clocks.alignment_report(*_days(spark, d))


@queries.add("embargo_split_counts", r.with_views("ch", more="""p AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM ch),
q AS (SELECT channel, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.6::DOUBLE) + 12 THEN 'embargo' WHEN i < floor(n * 0.8::DOUBLE) THEN 'valid' WHEN i < floor(n * 0.8::DOUBLE) + 12 THEN 'embargo' ELSE 'test' END AS part FROM p)""") + "SELECT channel, part, count(*) AS n FROM q GROUP BY 1, 2")
def embargo_split_counts(spark, d):
    split = clocks.embargo_split(r.channels(spark, d).withColumnRenamed("frame", "time"), 0.6, 0.2, 12, "channel")
    return split.groupBy("channel", "part").agg(F.count("*").alias("n"))


CORR_SQL = "cc AS (SELECT a.channel AS driver, b.channel AS driven, k AS lag, count(*) AS n, corr(a.value, b.value) AS r FROM range(0, 7) t(k), ch a JOIN ch b ON b.channel <> a.channel WHERE b.frame = a.frame + k GROUP BY 1, 2, 3)"


@queries.add("lagged_correlations", r.with_views("ch", more=CORR_SQL) + f"SELECT driver, driven, lag, n, {sql_round('r')} FROM cc")
def lagged_correlations(spark, d):
    return rounded(clocks.lagged_correlations(r.channels(spark, d), list(range(7))), "r")


@queries.add("best_lags", r.with_views("ch", more=CORR_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY driver, driven ORDER BY round(abs(r), 12) DESC, lag) AS i FROM cc)") + f"SELECT b.driver, b.driven, b.lag, b.n, {sql_round('b.r', 'r')}, abs(b.r) > abs(z.r) AND b.lag > 0 AS beyond_leakage FROM b JOIN cc z ON z.driver = b.driver AND z.driven = b.driven AND z.lag = 0 WHERE i = 1")
def best_lags(spark, d):
    return rounded(clocks.best_lags(clocks.lagged_correlations(r.channels(spark, d), list(range(7)))), "r")


R1_SQL = """cv AS (SELECT channel, frame, value - avg(value) OVER (PARTITION BY channel) AS v FROM ch), cw AS (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY frame) AS w FROM cv),
r1 AS (SELECT channel, count(*) AS n, sum(v * w) / sum(v * v) AS r1 FROM cw GROUP BY 1)"""


@queries.add("record_memory", r.with_views("ch", more=R1_SQL) + f"SELECT channel, n, {sql_round('r1')}, {sql_round('(1 + least(greatest(r1, 0), 0.999)) / (1 - least(greatest(r1, 0), 0.999))', 'memory')} FROM r1")
def record_memory(spark, d):
    return rounded(clocks.memory(r.channels(spark, d), "channel"), "r1", "memory")


@queries.add("effective_sizes", r.with_views("ch", more=R1_SQL) + f"SELECT a.channel AS left, b.channel AS right, {sql_round('greatest(3.0, a.n * (1 - least(greatest(a.r1 * b.r1, -0.999), 0.999)) / (1 + least(greatest(a.r1 * b.r1, -0.999), 0.999)))', 'n_effective')} FROM r1 a JOIN r1 b ON a.channel < b.channel")
def effective_sizes(spark, d):
    return rounded(clocks.effective_sizes(r.channels(spark, d)), "n_effective")


ACF_SQL = """cv AS (SELECT channel, frame, value - avg(value) OVER (PARTITION BY channel) AS v FROM ch), q AS (SELECT channel, sum(v * v) AS q FROM cv GROUP BY 1),
acf AS (SELECT a.channel, k AS lag, sum(a.v * b.v) / any_value(q) AS acf FROM range(1, 49) t(k), cv a JOIN cv b ON a.channel = b.channel JOIN q ON q.channel = a.channel WHERE b.frame = a.frame + k GROUP BY 1, 2)"""


@queries.add("autocorrelations", r.with_views("ch", more=ACF_SQL) + f"SELECT channel, lag::INT AS lag, {sql_round('acf')} FROM acf")
def autocorrelations(spark, d):
    return rounded(clocks.autocorrelations(r.channels(spark, d), 48, "channel"), "acf")


@queries.add("decorrelation", r.with_views("ch", more=ACF_SQL) + "SELECT channel, coalesce(min(lag) FILTER (abs(acf) < 1 / 2.718281828459045::DOUBLE), 48)::BIGINT AS decorrelation FROM acf GROUP BY 1")
def decorrelation(spark, d):
    return clocks.decorrelation(r.channels(spark, d), 48, "channel")


@queries.add("stationarity", r.with_views("ch", more="h AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY frame) AS i, count(*) OVER (PARTITION BY channel) AS m FROM ch)") + f"SELECT channel, count(*) AS n, {sql_round('var_pop(value) FILTER (i > m // 2) / var_pop(value) FILTER (i <= m // 2)', 'variance_ratio')}, {sql_round('regr_slope(value, frame)', 'slope')} FROM h GROUP BY 1")
def stationarity(spark, d):
    return rounded(clocks.stationarity(r.channels(spark, d), "channel"), "variance_ratio", "slope")


@queries.add("calendar_anomalies", r.with_views("ch") + f"SELECT channel, frame, {sql_round('value - avg(value) OVER (PARTITION BY channel, frame % 24)', 'anomaly', 5)} FROM ch")
def calendar_anomalies(spark, d):
    return rounded(clocks.anomalies(r.channels(spark, d), F.col("frame") % 24, "channel").select("channel", "frame", "anomaly"), "anomaly", digits=5)


HARMONIC_SQL = """t AS (SELECT channel, sin(frame * (2 * 3.141592653589793::DOUBLE / 24)) AS s, cos(frame * (2 * 3.141592653589793::DOUBLE / 24)) AS c, value AS y FROM ch),
g AS (SELECT channel, count(*) AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(y) AS y, sum(s * y) AS sy, sum(c * y) AS cy FROM t GROUP BY 1),
e AS (SELECT *, ss - s * s / n AS a, sc - s * c / n AS b, cc - c * c / n AS d, sy - s * y / n AS p, cy - c * y / n AS q FROM g),
f AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS sine, (q * a - p * b) / (a * d - b * b) AS cosine FROM e)"""


@queries.add("harmonic_climatology", r.with_views("ch", more=HARMONIC_SQL) + f"SELECT channel, {sql_round('y / n - sine * s / n - cosine * c / n', 'mean')}, {sql_round('sine')}, {sql_round('cosine')} FROM f")
def harmonic_climatology(spark, d):
    return rounded(clocks.harmonic_climatology(r.channels(spark, d), 24.0, "channel"), "mean", "sine", "cosine")


@queries.add("normalisation_moments", r.with_views("ch") + f"SELECT channel, count(value) AS n, {sql_round('avg(value)', 'mean')}, {sql_round('stddev_pop(value)', 'deviation')} FROM ch WHERE frame < 432 GROUP BY 1")
def normalisation_moments(spark, d):
    return rounded(clocks.normalisation(r.channels(spark, d), F.col("frame") < 432, "channel"), "mean", "deviation")


# Information

CODES_SQL = """edges AS (SELECT channel, quantile_cont(value, [1/6, 2/6, 3/6, 4/6, 5/6]) AS e FROM ch GROUP BY 1),
codes AS (SELECT channel, frame, len([x FOR x IN e IF x <= value])::INT AS code FROM ch JOIN edges USING (channel))"""


def entropy_sql(cells: str, groups: str, source: str) -> str:
    return f"(SELECT {groups}, ln(sum(k)) - sum(k * ln(k)) / sum(k) + (count(*) - 1) / (2 * sum(k)) AS h, sum(k)::BIGINT AS n FROM (SELECT {groups}, count(*) AS k FROM {source} GROUP BY {groups}, {cells}) GROUP BY {groups})"


def _codes(spark, d):
    return dependence.quantile_codes(r.channels(spark, d), 6, "channel").select("channel", "frame", "code")


@queries.add("quantile_codes", r.with_views("ch", more=CODES_SQL) + "SELECT channel, frame, code FROM codes")
def quantile_codes(spark, d):
    return _codes(spark, d)


LAGGED_SQL = CODES_SQL + """, lg AS (SELECT s.channel AS source, t.channel AS target, k AS lag, s.code AS x, t.code AS past, f.code AS future FROM range({0}, {1}) z(k), codes s JOIN codes t ON s.frame = t.frame AND s.channel <> t.channel JOIN codes f ON f.channel = t.channel WHERE f.frame = (t.frame + k) % (SELECT max(frame) + 1 FROM codes))"""


@queries.add("lagged_information", r.with_views("ch", more=LAGGED_SQL.format(0, 4)) + f"SELECT source, target, lag, a.n, {sql_round('greatest(0.0, a.h + b.h - c.h)', 'mi')} FROM {entropy_sql('x', 'source, target, lag', 'lg')} a JOIN {entropy_sql('future', 'source, target, lag', 'lg')} b USING (source, target, lag) JOIN {entropy_sql('x, future', 'source, target, lag', 'lg')} c USING (source, target, lag)")
def lagged_information(spark, d):
    return rounded(dependence.lagged_information(_codes(spark, d), [0, 1, 2, 3], r.record_length(spark, d)), "mi")


@queries.add("transfer_entropy", r.with_views("ch", more=LAGGED_SQL.format(1, 4)) + f"SELECT source, target, lag, a.n, {sql_round('greatest(0.0, a.h + b.h - c.h - e.h)', 'te')} FROM {entropy_sql('future, past', 'source, target, lag', 'lg')} a JOIN {entropy_sql('x, past', 'source, target, lag', 'lg')} b USING (source, target, lag) JOIN {entropy_sql('past', 'source, target, lag', 'lg')} c USING (source, target, lag) JOIN {entropy_sql('future, x, past', 'source, target, lag', 'lg')} e USING (source, target, lag)")
def transfer_entropy(spark, d):
    return rounded(dependence.transfer_entropy(_codes(spark, d), [1, 2, 3], r.record_length(spark, d)), "te")


SAMPLE_SQL = "q AS (SELECT quantile_cont(quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(discount, [0.25, 0.5, 0.75]) AS b, quantile_cont(tax, [0.25, 0.5, 0.75]) AS c, quantile_cont(target, [0.25, 0.5, 0.75]) AS t FROM smp), sc AS (SELECT len([x FOR x IN a IF x <= quantity]) AS quantity, len([x FOR x IN b IF x <= discount]) AS discount, len([x FOR x IN c IF x <= tax]) AS tax, len([x FOR x IN t IF x <= target]) AS target, flag FROM smp, q)"


def _sample_codes(spark, d):
    rows = r.samples(spark, d)
    for c in ("quantity", "discount", "tax", "target"):
        rows = dependence.quantile_codes(rows, 4, value=c, code=c)
    return rows


PAIR_SQL = ", pq AS (SELECT 'quantity' AS a, 'discount' AS b, quantity AS x, discount AS y, target AS t FROM sc UNION ALL SELECT 'quantity', 'tax', quantity, tax, target FROM sc UNION ALL SELECT 'discount', 'tax', discount, tax, target FROM sc)"
_H = lambda cells: entropy_sql(cells, "a, b", "pq")


@queries.add("pair_structure", r.with_views("smp", more=SAMPLE_SQL + PAIR_SQL) + f"""SELECT a, b, hx.n, {sql_round('hx.h + ht.h - hxt.h', 'mi_a')}, {sql_round('hy.h + ht.h - hyt.h', 'mi_b')}, {sql_round('hxy.h + ht.h - hxyt.h', 'mi_ab')}, {sql_round('hx.h + ht.h - hxt.h + hy.h + ht.h - hyt.h - (hxy.h + ht.h - hxyt.h)', 'interaction')}
FROM {_H('x')} hx JOIN {_H('y')} hy USING (a, b) JOIN {_H('t')} ht USING (a, b) JOIN {_H('x, t')} hxt USING (a, b) JOIN {_H('y, t')} hyt USING (a, b) JOIN {_H('x, y')} hxy USING (a, b) JOIN {_H('x, y, t')} hxyt USING (a, b)""")
def pair_structure(spark, d):
    return rounded(dependence.pair_structure(_sample_codes(spark, d), ["quantity", "discount", "tax"], "target"), "mi_a", "mi_b", "mi_ab", "interaction")


@queries.add("conditional_support", r.with_views("smp", more=SAMPLE_SQL) + "SELECT flag AS stratum, count(*) AS n, count(DISTINCT quantity) AS x_levels, count(DISTINCT target) AS y_levels, count(DISTINCT (quantity, target)) AS cells, count(*) >= 5 * count(DISTINCT (quantity, target)) AND count(DISTINCT quantity) >= 2 AND count(DISTINCT target) >= 2 AS admitted FROM sc GROUP BY 1")
def conditional_support(spark, d):
    return dependence.conditional_support(_sample_codes(spark, d), F.col("flag"), "quantity", "target", 5)


@queries.add("conditional_information", r.with_views("smp", more=SAMPLE_SQL + ", z AS (SELECT *, 1 AS one FROM sc)") + f"SELECT a.n, {sql_round('a.h + b.h - c.h - e.h', 'cmi')} FROM {entropy_sql('quantity, flag', 'one', 'z')} a, {entropy_sql('target, flag', 'one', 'z')} b, {entropy_sql('flag', 'one', 'z')} c, {entropy_sql('quantity, target, flag', 'one', 'z')} e")
def conditional_information(spark, d):
    rows = _sample_codes(spark, d).withColumn("one", F.lit(1))
    return rounded(dependence.conditional_information(rows, ["one"], "quantity", "target", "flag").drop("one"), "cmi")


@queries.add("shift_null", r.with_views("ch", more=CODES_SQL + """, pr AS (SELECT a.channel AS s, b.channel AS t FROM (SELECT DISTINCT channel FROM codes) a JOIN (SELECT DISTINCT channel FROM codes) b ON a.channel <> b.channel), len AS (SELECT max(frame) + 1 AS n FROM codes),
sh AS (SELECT n, unnest(range(1, n)) AS shift FROM len), ok AS (SELECT n, shift FROM sh WHERE least(shift % n, n - shift % n) >= 24 AND least((shift + 1) % n, n - (shift + 1) % n) >= 24),
sx AS (SELECT x.channel AS source, y.channel AS target, shift, x.code AS x, y.code AS y FROM ok JOIN codes x ON true JOIN codes y ON y.frame = (x.frame + shift + 1) % n AND y.channel <> x.channel)""") + f"SELECT source, target, shift, {sql_round('greatest(0.0, a.h + b.h - c.h)', 'mi')} FROM {entropy_sql('x', 'source, target, shift', 'sx')} a JOIN {entropy_sql('y', 'source, target, shift', 'sx')} b USING (source, target, shift) JOIN {entropy_sql('x, y', 'source, target, shift', 'sx')} c USING (source, target, shift)")
def shift_null(spark, d):
    return rounded(dependence.shifted_information(_codes(spark, d), 1, r.record_length(spark, d), 24), "mi")
