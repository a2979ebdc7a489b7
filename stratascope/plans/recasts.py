"""The driver's tables seen as series, channels, fields, supports, profiles and ensembles; and the same as DuckDB views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascope.operators.clocks import seconds
from stratascope.operators.events import on_grid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(column: str):
    return F.floor(seconds(F.col(column)) / 3600).cast("long")


def day(column: str):
    return F.floor(seconds(F.col(column)) / 86400).cast("long")


def series(spark, d) -> DataFrame:
    """(pattern, frame): event types by hour."""
    return on_grid(read(spark, d, "events"), F.col("event_type"), hour("ts"))


def user_series(spark, d) -> DataFrame:
    return on_grid(read(spark, d, "events"), F.col("user_id"), hour("ts"))


def channels(spark, d) -> DataFrame:
    """(channel, frame, value): summed value of each event type and hour, frames from 0."""
    e = read(spark, d, "events").where("event_type IS NOT NULL AND ts IS NOT NULL").withColumn("frame", hour("ts"))
    first = e.agg(F.min("frame").alias("first"))
    return e.crossJoin(F.broadcast(first)).groupBy(F.col("event_type").alias("channel"), (F.col("frame") - F.col("first")).alias("frame")).agg(F.round(F.sum("value"), 4).alias("value"))


def sessions(spark, d) -> DataFrame:
    """(user_id, start, end): a quarter of an hour from each event, in seconds."""
    return read(spark, d, "events").select("user_id", seconds(F.col("ts")).alias("start"), (seconds(F.col("ts")) + 900).alias("end"))


def supports(spark, d) -> DataFrame:
    """(orderkey, start, end): from an order's first to the day after its last shipment, in days."""
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.min(day("l_shipdate")).alias("start"), (F.max(day("l_shipdate")) + 1).alias("end"))


def samples(spark, d) -> DataFrame:
    """(quantity, discount, tax, size, target): rows of lineitem with the part's size."""
    parts = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"))
    return read(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "size", "retail", F.col("l_extendedprice").alias("target"), F.col("l_returnflag").alias("flag"))


def field(spark, d) -> DataFrame:
    """(y, x, value): revenue by month of order and nation of the customer; months from the first."""
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("x"))
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("m", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long"))
    first = o.agg(F.min("m").alias("first"))
    return o.crossJoin(F.broadcast(first)).groupBy((F.col("m") - F.col("first")).alias("y"), "x").agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("value"))


def extent(spark, d) -> tuple[int, int]:
    """Rows and columns of the field."""
    last = field(spark, d).agg(F.max("y"), F.max("x")).first()
    return (last[0] or 0) + 1, (last[1] or 0) + 1


def record_length(spark, d) -> int:
    """Frames of the channels' record."""
    return (channels(spark, d).agg(F.max("frame")).first()[0] or 0) + 1


def pairs(spark, d) -> DataFrame:
    """(y, x, truth, forecast): a cell's revenue, and that of the month before as its forecast."""
    f = field(spark, d)
    return f.withColumnRenamed("value", "truth").join(f.select((F.col("y") + 1).alias("y"), "x", F.col("value").alias("forecast")), ["y", "x"])


def monthly(spark, d) -> DataFrame:
    """(nation, frame, value) with the mean of this month and the last two as a forecast."""
    f = field(spark, d).select(F.col("x").alias("nation"), F.col("y").alias("frame"), "value")
    back = f.select("nation", (F.col("frame") + 1).alias("frame"), F.col("value").alias("b")).join(f.select("nation", (F.col("frame") + 2).alias("frame"), F.col("value").alias("c")), ["nation", "frame"])
    return f.join(back, ["nation", "frame"], "left").withColumn("forecast", (F.col("value") + F.col("b") + F.col("c")) / 3).drop("b", "c")


def ensemble(spark, d) -> DataFrame:
    """(nation, frame, member, value, truth): the five months before as members for a month."""
    f = field(spark, d).select(F.col("x").alias("nation"), F.col("y").alias("frame"), "value")
    m = f.select("nation", "frame", "value", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("member")).withColumn("frame", F.col("frame") + F.col("member"))
    return m.join(f.withColumnRenamed("value", "truth"), ["nation", "frame"])


def profiles(spark, d) -> DataFrame:
    """(profile, seq, pressure, value): an order's lines, 10 units of pressure a line, and their price."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_linenumber") * 10.0).alias("pressure"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def dealings(spark, d) -> DataFrame:
    """(supplier, day): the days on which a supplier shipped anything."""
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), day("l_shipdate").alias("day")).distinct()


#: The same as common table expressions.
SECONDS = "date_diff('second', TIMESTAMP '1970-01-01', {0})"
HOUR, DAY = f"({SECONDS} // 3600)", f"({SECONDS} // 86400)"
SQL = {
    "ev": f"ev AS (SELECT DISTINCT event_type AS pattern, {HOUR.format('ts')} AS frame FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL)",
    "uev": f"uev AS (SELECT DISTINCT user_id AS pattern, {HOUR.format('ts')} AS frame FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)",
    "ch": f"ch AS (SELECT event_type AS channel, {HOUR.format('ts')} - (SELECT min({HOUR.format('ts')}) FROM events WHERE event_type IS NOT NULL) AS frame, round(sum(value), 4) AS value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)",
    "ss": f"ss AS (SELECT user_id, {SECONDS.format('ts')} AS \"start\", {SECONDS.format('ts')} + 900 AS \"end\" FROM events)",
    "sup": f"sup AS (SELECT l_orderkey AS orderkey, min({DAY.format('l_shipdate')}) AS \"start\", max({DAY.format('l_shipdate')}) + 1 AS \"end\" FROM lineitem GROUP BY 1)",
    "smp": "smp AS (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, p_size::DOUBLE AS size, p_retailprice AS retail, l_extendedprice AS target, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "om": "om AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, c_nationkey::BIGINT AS x, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)",
    "fld": "fld AS (SELECT m - (SELECT min(m) FROM om) AS y, x, round(sum(o_totalprice), 2) / 1000 AS value FROM om GROUP BY 1, 2)",
    "prs": "prs AS (SELECT a.y, a.x, a.value AS truth, b.value AS forecast FROM fld a JOIN fld b ON a.y = b.y + 1 AND a.x = b.x)",
    "mon": "mon AS (SELECT a.x AS nation, a.y AS frame, a.value, (a.value + b.value + c.value) / 3 AS forecast FROM fld a LEFT JOIN (fld b JOIN fld c ON b.x = c.x AND b.y = c.y + 1) ON a.x = b.x AND a.y = b.y + 1)",
    "ens": "ens AS (SELECT a.x AS nation, a.y AS frame, k AS member, b.value, a.value AS truth FROM fld a, range(1, 6) r(k), fld b WHERE b.x = a.x AND b.y = a.y - k)",
    "prf": "prf AS (SELECT l_orderkey AS profile, l_linenumber::BIGINT AS seq, l_linenumber * 10.0::DOUBLE AS pressure, l_extendedprice AS value, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS status FROM lineitem)",
    "dl": f"dl AS (SELECT DISTINCT l_suppkey AS supplier, {DAY.format('l_shipdate')} AS day FROM lineitem)",
}
NEEDS = {"fld": ("om",), "prs": ("om", "fld"), "mon": ("om", "fld"), "ens": ("om", "fld")}


def with_views(*names: str, more: str = "") -> str:
    """WITH and the named views, in order, and further ones."""
    order = dict.fromkeys(n for name in names for n in (*NEEDS.get(name, ()), name))
    parts = [SQL[n] for n in order] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
