"""Data sources by name and priority, monthly shards, content-addressed tables, a simulated cube as a Spark data source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratascope.errors import Refused


@dataclass(order=True)
class Source:
    priority: int
    name: str
    claims: Callable[[str], bool] = field(compare=False)
    read: Callable[[SparkSession, str], DataFrame] = field(compare=False)
    simulated: bool = field(default=False, compare=False)


class Sources:
    """Sources claim data set names; the first of them, by priority, that can read one gives it."""

    def __init__(self):
        self._all: dict[str, Source] = {}

    def register(self, source: Source, replace: bool = False) -> None:
        if source.name in self._all and not replace:
            raise Refused(f"a source called {source.name} is registered")
        self._all[source.name] = source

    def candidates(self, name: str) -> list[Source]:
        return sorted(s for s in self._all.values() if s.claims(name))

    def resolve(self, spark: SparkSession, name: str) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The data, with its source's name as a column, and a record of every attempt."""
        attempts: list[tuple[str, str]] = []
        for s in self.candidates(name):
            try:
                df = s.read(spark, name)
            except Exception as e:  # any reader may fail in its own way; the next one is asked
                attempts.append((s.name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
                continue
            attempts.append((s.name, "read"))
            return df.withColumn("source_name", F.lit(s.name)), attempts
        raise Refused(f"no source gave {name}: {attempts}")


def monthly_shards(ranges: DataFrame) -> DataFrame:
    """name, month, first, last: inclusive date ranges (name, start, end) cut at calendar months."""
    months = ranges.withColumn("month", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))))
    return months.select("name", "month", F.greatest("month", "start").alias("first"), F.least(F.last_day("month"), F.col("end")).alias("last"))


def content_blocks(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, n, sha256 of the rows in key order within each block of keys; every column counts."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    per_row = df.select((F.col(key) % blocks).alias("block"), F.col(key).alias("_k"), F.sha2(row, 256).alias("h"))
    return per_row.groupBy("block").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def content_hash(df: DataFrame, key: str, blocks: int = 64) -> str:
    """One hash of all blocks' hashes; ``blocks`` short strings come to the driver."""
    import hashlib

    rows = content_blocks(df, key, blocks).orderBy("block").collect()
    return hashlib.sha256("".join(r["sha256"] for r in rows).encode()).hexdigest()


class ArtifactStore:
    """Tables under the hash of their content, written once and checked when read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, df: DataFrame, key: str) -> str:
        name = content_hash(df, key)
        try:
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
        return name

    def load(self, name: str, key: str, verify: bool = True) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        if verify and content_hash(df, key) != name:
            raise Refused(f"the content of {name} has changed")
        return df


class SimulatedCube(DataSource):
    """A made-up reanalysis cube (time, lat, lon, value): spark.read.format("simulated_cube"), a partition for each block of times."""

    @classmethod
    def name(cls) -> str:
        return "simulated_cube"

    def schema(self) -> str:
        return "time long, lat double, lon double, value double"

    def reader(self, schema) -> DataSourceReader:
        return _CubeReader(int(self.options.get("times", "24")), int(self.options.get("rows", "10")), int(self.options.get("columns", "20")), int(self.options.get("partitions", "4")))


class _CubeReader(DataSourceReader):
    def __init__(self, times: int, rows: int, columns: int, partitions: int):
        self.times, self.rows, self.columns, self.parts = times, rows, columns, max(1, partitions)

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        import math

        for t in range(partition.value, self.times, self.parts):
            for i in range(self.rows):
                for j in range(self.columns):
                    lat, lon = -90 + 180 * (i + 0.5) / self.rows, 360 * j / self.columns
                    yield t, lat, lon, 15 * math.cos(math.radians(lat)) + 3 * math.sin(math.radians(lon) + 2 * math.pi * t / 24)
