"""Delimited records: facts about columns, strict reading on a clock, export with provenance."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascope.errors import Refused


def probe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, missing, distinct, numeric, low, high: facts about each column, read as text."""
    names = columns or df.columns
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in names]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    number = F.expr("try_cast(v AS DOUBLE)")
    g = long.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(F.col("v").isNull() | (F.col("v") == "")).alias("missing"), F.countDistinct("v").alias("distinct"), F.count(number).alias("_n"), F.min(number).alias("low"), F.max(number).alias("high"))
    numeric = (F.col("_n") == F.col("rows") - F.col("missing")) & (F.col("_n") > 0)
    return g.select("column", "rows", "missing", "distinct", numeric.alias("numeric"), F.when(numeric, F.col("low")).alias("low"), F.when(numeric, F.col("high")).alias("high"))


def checked_clock(df: DataFrame, time: str, order: str) -> DataFrame:
    """``df`` if its time strictly increases in the given order; otherwise it is refused.

    Ranges of the order are checked where they are; what meets at their edges is compared from one row a range.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = low = bad = None
        for batch in batches:
            times, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for t, at in zip(times, places):
                if bad is None and (t is None or last is not None and t <= last):
                    bad = at
                first, low = (t, at) if low is None else (first, low)
                last = t
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((low, pa.int64()), (first, pa.float64()), (last, pa.float64()), (bad, pa.int64()))], ["low", "first", "last", "bad"])

    rows = df.select(F.col(time).cast("double").alias("t"), F.col(order).cast("long").alias("at")).repartitionByRange("at").sortWithinPartitions("at")
    before = None
    for r in rows.mapInArrow(check, "low long, first double, last double, bad long").orderBy("low").collect():  # a row a range
        edge = before is not None and r["first"] is not None and r["first"] <= before
        wrong = r["low"] if edge else r["bad"]
        if wrong is not None:
            raise Refused(f"{time} doesn't increase at {order} {wrong}")
        before = r["last"]
    return df


def read_channels(spark: SparkSession, path: str, time: str, channels: list[str], delimiter: str = ",") -> DataFrame:
    """(channel, time, value) of a delimited file with a header; values that aren't numbers are refused, blanks are missing."""
    raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    if absent := [c for c in [time, *channels] if c not in raw.columns]:
        raise Refused(f"the file has no column {', '.join(absent)}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    wrong = raw.select([F.count_if(F.col(f"`{c}`").isNotNull() & number(c).isNull()).alias(c) for c in [time, *channels]]).first()
    if bad := [c for c in [time, *channels] if wrong[c]]:
        raise Refused(f"not all of {', '.join(bad)} are numbers")
    numbered = raw.withColumn("_at", F.monotonically_increasing_id()).select("_at", number(time).alias("time"), *[number(c).alias(c) for c in channels])
    checked_clock(numbered, "time", "_at")
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").alias("value")) for c in channels])
    return numbered.select("time", F.explode(pairs).alias("p")).select("p.channel", "time", "p.value")


def export(df: DataFrame, path: str, fmt: str, provenance: dict) -> None:
    """Writes csv, json or parquet under ``path``/data and the provenance beside it; an existing path is refused."""
    if fmt not in ("csv", "json", "parquet"):
        raise Refused(f"{fmt} is not an export format")
    flat = df.select(*[F.to_json(c).alias(c) if fmt == "csv" and t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = flat.write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/data")
    record = json.dumps(provenance | {"format": fmt, "columns": df.columns}, sort_keys=True)
    df.sparkSession.createDataFrame([(record,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/provenance")
