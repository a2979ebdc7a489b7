"""The same operators on streams: hourly grids, sessions, merged supports, journals.

A window counts once the watermark has passed it; state is bounded by the watermark or by the longest carry.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratascope.operators.clocks import seconds


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream of files, with t as a time that doesn't depend on the session's zone."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("t", F.timestamp_seconds(seconds(F.col("ts"))))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, event_type, n, total in tumbling hours."""
    g = events.withWatermark("t", late).groupBy(F.window("t", "1 hour").alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select((F.unix_seconds("w.start") / 3600).cast("long").alias("hour"), "event_type", "n", "total")


def merged_supports(events: DataFrame, length: int, late: str = "2 hours") -> DataFrame:
    """user_id, start, end of merged supports of ``length`` seconds; the open one of each user is state.

    A support is sent on when a later event leaves a gap after it, or when the watermark has passed its end.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "start": [open_[0]], "end": [open_[1]]})
            return
        times = sorted(int(x) for b in batches for x in b["s"])
        closed = []
        for s in times:
            if open_ is not None and s <= open_[1]:
                open_ = (open_[0], max(open_[1], s + length))
            else:
                if open_ is not None:
                    closed.append(open_)
                open_ = (s, s + length)
        state.update(open_)
        state.setTimeoutTimestamp(max(open_[1] * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(closed), "start": [c[0] for c in closed], "end": [c[1] for c in closed]})

    rows = events.withWatermark("t", late).select("user_id", "t", F.unix_seconds("t").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, start long, end long", "start long, end long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_by_key(stream: DataFrame, key: str, order: str, detail: str) -> DataFrame:
    """key, n, detail of the last entry: a journal folded as it grows."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max_by(detail, order).alias("detail"))


def run_once(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """All that is there now, through the stream, as a table of (batch, row) files; later batches replace rows of earlier ones.

    ``folder`` must be shared by the cluster; it holds the stream's checkpoint and its result.
    """
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = lambda df, i: df.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(f"{path}/data")
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long"
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/data")


def newest(table: DataFrame, *key: str) -> DataFrame:
    """Each key's row of its last batch."""
    rest = [c for c in table.columns if c not in (*key, "batch")]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
