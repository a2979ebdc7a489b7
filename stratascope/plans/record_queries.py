"""Queries over points, profiles, regions and the records of analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratascope.operators import governance, neighbours, profiles
from stratascope.plans import recasts as r
from stratascope.plans.registry import Registry, rounded, sql_round

queries = Registry()
K = 5

# Neighbours: all vectors ask, and all answer.
UNIT_SQL = """v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS a, [x::DOUBLE FOR x IN embedding[1:32]] AS b FROM embeddings),
q AS (SELECT * FROM v),
sim AS (SELECT q.vec_id AS id, v.vec_id AS other, round(list_cosine_similarity(q.a, v.a), 9) AS s, round(list_cosine_similarity(q.b, v.b), 9) AS t FROM q JOIN v ON q.vec_id <> v.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS i, row_number() OVER (PARTITION BY id ORDER BY t DESC, other) AS j FROM sim)"""


def _near(spark, d, dims=64):
    v = r.read(spark, d, "embeddings").withColumn("v", F.slice("embedding", 1, dims))
    return neighbours.similarities(v, v, "vec_id", "v", K)


@queries.add("nearest_by_cosine", f"WITH {UNIT_SQL} SELECT id, other, {sql_round('s', 'similarity')}, i::INT AS rank FROM near WHERE i <= {K}")
def nearest_by_cosine(spark, d):
    return rounded(_near(spark, d), "similarity")


@queries.add("mutual_knn_alignment", f"WITH {UNIT_SQL} SELECT count(DISTINCT id) AS points, count(*) FILTER (i <= {K} AND j <= {K}) AS shared, {sql_round(f'count(*) FILTER (i <= {K} AND j <= {K}) / (count(DISTINCT id) * {K})', 'alignment')} FROM near")
def mutual_knn_alignment(spark, d):
    return rounded(neighbours.mutual_alignment(_near(spark, d), _near(spark, d, 32), K), "alignment")


DIST_SQL = """dd AS (SELECT c.c_custkey AS l, s.s_suppkey AS r, round(abs(c.c_acctbal - s.s_acctbal), 6) AS d FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey),
rk AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS i, row_number() OVER (PARTITION BY r ORDER BY d, l) AS j, lead(d) OVER (PARTITION BY l ORDER BY d, r) AS nxt FROM dd)"""


def _balances(spark, d):
    c = r.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("k"))
    s = r.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.col("s_nationkey").alias("k"))
    return c, s


@queries.add("mutual_nearest", f'WITH {DIST_SQL} SELECT l AS "left", r AS "right", d AS distance FROM rk WHERE i = 1 AND j = 1')
def mutual_nearest(spark, d):
    return neighbours.mutual_nearest_values(*_balances(spark, d), "k")


@queries.add("ratio_margin", f'WITH {DIST_SQL} SELECT l AS "left", r AS "right", d AS distance, {sql_round("d / nxt", "ratio")} FROM rk WHERE i = 1 AND nxt > 0 AND d / nxt <= 0.6')
def ratio_margin(spark, d):
    return rounded(neighbours.ratio_margin_values(*_balances(spark, d), 0.6, "k"), "ratio")


PLACES_SQL = "fx AS (SELECT c_custkey AS id, c_custkey % 120 - 60.0::DOUBLE AS lat, (c_custkey * 37) % 360 - 180.0::DOUBLE AS lon FROM customer), ft AS (SELECT (s_suppkey * 7) % 120 - 60.0::DOUBLE AS lat, (s_suppkey * 53) % 360 - 180.0::DOUBLE AS lon FROM supplier)"
KM_SQL = "2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@queries.add("theta_join_haversine", f"WITH {PLACES_SQL}, m AS (SELECT a.id, {KM_SQL} AS km FROM fx a, ft b), n AS (SELECT id, count(*) AS n, min(km) AS k FROM m WHERE km <= 900 GROUP BY 1) SELECT fx.id, coalesce(n, 0) AS n, {sql_round('k', 'nearest_km', 4)} FROM fx LEFT JOIN n USING (id)")
def theta_join_haversine(spark, d):
    place = lambda df, key, a, b: df.select(F.col(key).alias("id"), ((F.col(key) * a) % 120 - 60.0).alias("lat"), ((F.col(key) * b) % 360 - 180.0).alias("lon"))
    fixes = place(r.read(spark, d, "customer"), "c_custkey", 1, 37)
    features = place(r.read(spark, d, "supplier"), "s_suppkey", 7, 53)
    return rounded(neighbours.features_within(fixes, features, 900.0), "nearest_km", digits=4)


@queries.add("constellations", "SELECT a.l_orderkey AS orderkey, a.l_linenumber || '+' || b.l_linenumber || '+' || c.l_linenumber AS members FROM lineitem a JOIN lineitem b USING (l_orderkey) JOIN lineitem c USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber AND b.l_linenumber < c.l_linenumber")
def constellations(spark, d):
    lines = r.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("member"))
    return neighbours.subsets(lines, 3, "orderkey")


REGIONS = [("north", 20, 60, -180, 180), ("south", -60, -20, -180, 180), ("west", -30, 30, -180, -10), ("east", -15, 15, -5, 170)]


@queries.add("region_assignment", f"""WITH {PLACES_SQL}, b AS (SELECT id, lat - 4 AS ly, lat + 4 AS hy, lon - 6 AS lx, lon + 6 AS hx FROM fx),
rg AS (SELECT * FROM (VALUES {", ".join(str(x) for x in REGIONS)}) t(region, ly, hy, lx, hx)),
m AS (SELECT b.id, count(rg.region) AS t, count(*) FILTER (b.ly >= rg.ly AND b.hy <= rg.hy AND b.lx >= rg.lx AND b.hx <= rg.hx) AS i, min(rg.region) FILTER (b.ly >= rg.ly AND b.hy <= rg.hy AND b.lx >= rg.lx AND b.hx <= rg.hx) AS region
  FROM b LEFT JOIN rg ON b.ly < rg.hy AND rg.ly < b.hy AND b.lx < rg.hx AND rg.lx < b.hx GROUP BY 1)
SELECT id, CASE WHEN t = 1 AND i = 1 THEN 'INSIDE' WHEN t >= 2 THEN 'STRADDLES' WHEN t = 1 THEN 'PARTLY_OUTSIDE' ELSE 'OUTSIDE' END AS verdict, CASE WHEN t = 1 AND i = 1 THEN region END AS region FROM m""")
def region_assignment(spark, d):
    c = r.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 120 - 60.0).alias("lat"), ((F.col("c_custkey") * 37) % 360 - 180.0).alias("lon"))
    boxes = c.select("id", (F.col("lat") - 4).alias("low_y"), (F.col("lat") + 4).alias("high_y"), (F.col("lon") - 6).alias("low_x"), (F.col("lon") + 6).alias("high_x"))
    regions = spark.createDataFrame(REGIONS, "region string, low_y long, high_y long, low_x long, high_x long")
    return neighbours.assign_regions(boxes, regions)


@queries.add("admission_bands", """WITH a AS (SELECT avg(p_retailprice) AS m, avg(p_size) AS n FROM part), x AS (SELECT p_partkey, p_retailprice / m AS u, p_size / n AS v FROM part, a)
SELECT p_partkey, concat_ws('+', CASE WHEN u > 1.2 OR u < 1 / 1.2::DOUBLE THEN 'price' END, CASE WHEN v > 2.0 OR v < 1 / 2.0::DOUBLE THEN 'size' END) AS reasons, NOT (u > 1.2 OR u < 1 / 1.2::DOUBLE OR v > 2.0 OR v < 1 / 2.0::DOUBLE) AS admitted FROM x""")
def admission_bands(spark, d):
    p = r.read(spark, d, "part")
    both = p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("m"), F.avg("p_size").alias("n"))))
    out = neighbours.band_reasons(both, {"price": (F.col("p_retailprice") / F.col("m"), 1.2), "size": (F.col("p_size") / F.col("n"), 2.0)})
    return out.select("p_partkey", F.array_join("reasons", "+").alias("reasons"), "admitted")


@queries.add("exact_pool_rank", f"WITH o AS (SELECT p_brand, max(p_retailprice) FILTER (p_partkey % 10 = 0) AS o FROM part GROUP BY 1) SELECT p_brand, count(*) AS pool, count(*) FILTER (p_retailprice > o) AS above, count(*) FILTER (p_retailprice = o) AS tied, {sql_round('(1 + count(*) FILTER (p_retailprice > o) + count(*) FILTER (p_retailprice = o)) / (1 + count(*))', 'p_value')} FROM part JOIN o USING (p_brand) WHERE p_partkey % 10 <> 0 AND o IS NOT NULL GROUP BY 1")
def exact_pool_rank(spark, d):
    p = r.read(spark, d, "part")
    seen = p.where("p_partkey % 10 = 0").groupBy("p_brand").agg(F.max("p_retailprice").alias("o"))
    pool = p.where("p_partkey % 10 <> 0").join(seen, "p_brand")
    return rounded(neighbours.pool_rank(pool, F.col("o"), F.col("p_retailprice"), "p_brand"), "p_value")


# Profiles

EDGES = [0.0, 20.0, 40.0, 70.0]


@queries.add("depth_bin_mean", r.with_views("prf", more="b AS (SELECT profile, CASE WHEN pressure >= 0 AND pressure < 20 THEN 0 WHEN pressure >= 20 AND pressure < 40 THEN 1 WHEN pressure >= 40 AND pressure <= 70 THEN 2 END AS bin, value FROM prf), g AS (SELECT profile, bin, count(value) AS n, avg(value) AS mean FROM b WHERE bin IS NOT NULL GROUP BY 1, 2)") + f"SELECT p.profile, k::INT AS bin, coalesce(n, 0) AS n, {sql_round('mean')} FROM (SELECT DISTINCT profile FROM prf) p CROSS JOIN range(0, 3) t(k) LEFT JOIN g ON g.profile = p.profile AND g.bin = k")
def depth_bin_mean(spark, d):
    return rounded(profiles.depth_bins(r.profiles(spark, d), EDGES, "profile"), "mean")


@queries.add("bracket_interpolation", r.with_views("prf", more="g AS (SELECT profile, max((pressure, value)) FILTER (pressure <= 35) AS a, min((pressure, value)) FILTER (pressure >= 35) AS b FROM prf WHERE value IS NOT NULL AND quantity > 10 GROUP BY 1)") + f"SELECT profile, {sql_round('a[2] + (b[2] - a[2]) * (35 - a[1]) / (b[1] - a[1])', 'value')} FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND b[1] - a[1] <= 20")
def bracket_interpolation(spark, d):
    return rounded(profiles.at_level(r.profiles(spark, d).where("quantity > 10"), 35.0, 20.0, "profile"), "value")


@queries.add("strict_profiles", r.with_views("prf", more="i AS (SELECT *, quantity - lag(quantity) OVER (PARTITION BY profile ORDER BY seq, quantity) AS step FROM prf WHERE quantity BETWEEN 5 AND 45), k AS (SELECT profile FROM i GROUP BY 1 HAVING count(*) FILTER (step <= 0) = 0)") + "SELECT profile, count(*) AS levels FROM i JOIN k USING (profile) GROUP BY 1")
def strict_profiles(spark, d):
    p = r.profiles(spark, d).withColumn("pressure", F.col("quantity")).withColumn("seq", F.col("seq") * 1000 + F.col("quantity"))
    return profiles.strict_profiles(p, 5, 45).groupBy("profile").agg(F.count("*").alias("levels"))


@queries.add("qc_coalesce_select", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'N') THEN l_discount WHEN l_linestatus IN ('O') THEN l_tax END AS value FROM lineitem")
def qc_coalesce_select(spark, d):
    l = r.read(spark, d, "lineitem")
    good = lambda c, s: F.when(F.col(c).isin(*s), 1).otherwise(4)
    return l.select("l_orderkey", "l_linenumber", profiles.admitted(F.col("l_discount"), good("l_returnflag", ("A", "N")), F.col("l_tax"), good("l_linestatus", ("O",))).alias("value"))


@queries.add("platforms_with_two", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(s_acctbal) >= 2")
def platforms_with_two(spark, d):
    s = r.read(spark, d, "supplier").withColumnRenamed("s_acctbal", "value")
    return profiles.platforms_with(s, 2, "s_nationkey").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@queries.add("deepest_per_storm", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1")
def deepest_per_storm(spark, d):
    return profiles.deepest(r.read(spark, d, "orders"), F.col("o_totalprice"), "o_custkey", order="o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@queries.add("rejection_census", "SELECT CASE WHEN NOT coalesce(o_orderstatus = 'F', false) THEN 'status' WHEN NOT coalesce(o_totalprice > 50000, false) THEN 'price' WHEN NOT coalesce(month(o_orderdate) BETWEEN 4 AND 9, false) THEN 'season' ELSE 'accepted' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def rejection_census(spark, d):
    rules = {"status": F.col("o_orderstatus") == "F", "price": F.col("o_totalprice") > 50000, "season": F.month("o_orderdate").between(4, 9)}
    return profiles.census(r.read(spark, d, "orders"), rules)


# Records of analyses


@queries.add("hash_chain", """WITH h AS (SELECT conv_id, turn, sha256('|' || coalesce(role, '') || '|' || coalesce(text, '')) AS content_sha256 FROM conversations)
SELECT conv_id, turn, content_sha256, lag(content_sha256) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_sha256 FROM h""")
def hash_chain(spark, d):
    return governance.chained(r.read(spark, d, "conversations"), ["role", "text"], "conv_id", order="turn").select("conv_id", "turn", "content_sha256", "previous_sha256")


@queries.add("hash_chain_verify", "SELECT conv_id, count(*) AS entries, true AS intact FROM conversations GROUP BY 1")
def hash_chain_verify(spark, d):
    own = governance.chained(r.read(spark, d, "conversations"), ["role", "text"], "conv_id", order="turn")
    return governance.verified_chains(own, ["role", "text"], "conv_id", order="turn")


JOURNAL_SQL = "j AS (SELECT o_custkey AS run, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'transition' WHEN o_orderkey % 4 = 1 THEN 'step_reused' ELSE 'step' END AS kind, o_orderpriority AS detail FROM orders)"


@queries.add("journal_fold", f"WITH {JOURNAL_SQL} SELECT run, arg_max(detail, seq) FILTER (kind = 'transition') AS state, count(*) FILTER (kind = 'step') AS steps, arg_max(detail, seq) FILTER (kind <> 'transition') AS last_outcome FROM j GROUP BY 1")
def journal_fold(spark, d):
    k = F.col("o_orderkey") % 4
    j = r.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), F.when(k == 0, "transition").when(k == 1, "step_reused").otherwise("step").alias("kind"), F.col("o_orderpriority").alias("detail"))
    return governance.folded(j, "run")


CATEGORIES = ["observations", "effect_sizes", "uncertainty", "replication_results", "confounders", "provenance", "temporal_precedence", "holdout_performance", "contradictions"]


@queries.add("claim_ladder", f"""WITH e AS (SELECT o_custkey AS bundle, ({CATEGORIES})[o_orderkey % 8 + 1] AS category, CASE WHEN o_orderkey % 97 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders),
g AS (SELECT bundle, bool_and(status <> 'FAIL') AS c, {", ".join(f"bool_or(category = '{c}' AND status = 'PASS') AS {c}" for c in CATEGORIES)} FROM e GROUP BY 1)
SELECT bundle, (['observation', 'association', 'robust', 'precursor', 'predictive'])[1 + (c AND observations AND effect_sizes AND uncertainty)::INT + (c AND observations AND effect_sizes AND uncertainty AND replication_results AND confounders)::INT
 + (c AND observations AND effect_sizes AND uncertainty AND replication_results AND confounders AND provenance AND temporal_precedence)::INT + (c AND observations AND effect_sizes AND uncertainty AND replication_results AND confounders AND provenance AND temporal_precedence AND holdout_performance)::INT] AS rung FROM g""")
def claim_ladder(spark, d):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    e = r.read(spark, d, "orders").select(F.col("o_custkey").alias("bundle"), F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("category"), F.when(F.col("o_orderkey") % 97 == 0, "FAIL").otherwise("PASS").alias("status"))
    return governance.claim_ladder(e, "bundle")


@queries.add("one_use_ledger", "SELECT o_custkey AS partition, o_orderkey AS opener FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def one_use_ledger(spark, d):
    o = r.read(spark, d, "orders").select(F.col("o_custkey").alias("partition"), F.col("o_orderkey").alias("opener"), F.col("o_orderdate").alias("opened"))
    return governance.one_use(o).select("partition", "opener")


QUERY = "the of thing and"


@queries.add("record_search", f"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents)
SELECT doc_id AS id, len(list_intersect(w, {sorted(QUERY.split())}))::INT AS score FROM w WHERE len(list_intersect(w, {sorted(QUERY.split())})) > 0 OR doc_id = 7 ORDER BY doc_id = 7 DESC, score DESC, doc_id LIMIT 8""")
def record_search(spark, d):
    return governance.searched(r.read(spark, d, "documents"), QUERY, 8, id_col="doc_id", text="text", primary=7)


@queries.add("causal_language_scan", f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\\b({'|'.join(governance.CAUSAL)})\\b'))::INT AS terms FROM documents")
def causal_language_scan(spark, d):
    return governance.wording(r.read(spark, d, "documents"), F.col("text")).select("doc_id", "terms")


@queries.add("paginate_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginate_desc(spark, d):
    return governance.page(r.read(spark, d, "orders"), 50, 100, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@queries.add("parameter_correlations", f"""WITH s AS (SELECT l_returnflag, 'l_discount' AS parameter, l_discount AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT l_returnflag, 'l_quantity', l_quantity, l_extendedprice FROM lineitem)
SELECT l_returnflag, parameter, 'l_extendedprice' AS metric, count(*) AS n, {sql_round('corr(x, y)', 'r')} FROM s GROUP BY 1, 2""")
def parameter_correlations(spark, d):
    return rounded(governance.screen_correlations(r.read(spark, d, "lineitem"), ["l_discount", "l_quantity"], ["l_extendedprice"], "l_returnflag"), "r")


@queries.add("parameter_anova", f"""WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS k, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT o_orderstatus, count(*) AS groups, sum(k) AS n, sum(k * m) AS s, sum(k * m * m) AS q, sum(k * v) AS within FROM g GROUP BY 1)
SELECT o_orderstatus, groups, n::BIGINT AS n, {sql_round('CASE WHEN groups > 1 AND within > 0 THEN ((q - s * s / n) / (groups - 1)) / (within / (n - groups)) END', 'f', 5)} FROM s""")
def parameter_anova(spark, d):
    return rounded(governance.screen_groups(r.read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"), "f", digits=5)


@queries.add("replication_gate", """WITH a AS (SELECT l_suppkey, l_orderkey % 2 AS half, avg(l_extendedprice) - 38000 AS excess, (l_suppkey * 13 + (l_orderkey % 2) * 7) % 100 / 500.0::DOUBLE AS q FROM lineitem GROUP BY 1, 2, l_orderkey % 2)
SELECT f.l_suppkey FROM a f JOIN a s USING (l_suppkey) WHERE f.half = 0 AND s.half = 1 AND f.q <= 0.05 AND s.q <= 0.05 AND f.excess > 0 AND s.excess > 0""")
def replication_gate(spark, d):
    a = r.read(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 2).alias("half")).agg((F.avg("l_extendedprice") - 38000).alias("excess"))
    a = a.withColumn("q", (F.col("l_suppkey") * 13 + F.col("half") * 7) % 100 / 500.0)
    return governance.replicated(a.where("half = 0"), a.where("half = 1"), "l_suppkey")
