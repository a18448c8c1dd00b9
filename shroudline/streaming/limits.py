"""Keyed sequential state: the sliding rate limit, in batch and as a stream, and the idiomatic stream twins.

A request is admitted if fewer than ``limit`` admitted requests of its client lie within the window; rejected requests
leave no trace, and one exactly a window old still counts.  That is sequential, not a window count.  The batch version
sorts each client's requests inside its partition and streams through them with at most ``limit`` times in memory; the
streaming version keeps the same times as list state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # newer releases name the processor's modules this way
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
except ImportError:  # pragma: no cover
    StatefulProcessor, StatefulProcessorHandle = object, object


class Admission:
    """Times of the admitted requests of one client, the newest ``limit`` at most."""

    def __init__(self, limit: int, window: float, times=()) -> None:
        self.limit, self.window, self.times = limit, window, deque(times)

    def admit(self, at: float) -> bool:
        while self.times and at - self.times[0] > self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def rate_limited(requests: DataFrame, client: str, time: str, tie: str, limit: int, window_s: float) -> DataFrame:
    """(client, tie, admitted) of every request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for pdf in batches:
            out = []
            for c, at in zip(pdf["c"], pdf["at"]):
                if state is None or c != who:
                    who, state = c, Admission(limit, window_s)
                out.append(state.admit(at))
            yield pd.DataFrame({client: pdf["c"], tie: pdf["k"], "admitted": out})

    slim = requests.where(F.col(client).isNotNull() & F.col(time).isNotNull()).select(F.col(client).alias("c"), F.col(tie).alias("k"), F.col(time).cast("timestamp").cast("double").alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    placed = slim.withColumn("place", F.xxhash64("c"))  # a column no earlier shuffle has, so the repartition is never dropped
    return placed.repartition("place").sortWithinPartitions("place", "c", "at", "k").mapInPandas(run, f"{client} {kinds['c']}, {tie} {kinds['k']}, admitted boolean")


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Admission(self.limit, self.window, [r[0] for r in self.held.get()] if self.held.exists() else [])
        for pdf in rows:
            pdf = pdf.sort_values(["at", "k"])
            done = [state.admit(at) for at in pdf["at"]]
            yield pd.DataFrame({"c": pdf["c"].values, "k": pdf["k"].values, "admitted": done})
        self.held.put([(t,) for t in state.times])

    def close(self) -> None: ...


def rate_limited_stream(requests: DataFrame, client: str, time: str, tie: str, limit: int, window_s: float) -> DataFrame:
    """The same as a streaming DataFrame; needs the RocksDB state store provider."""
    slim = requests.select(F.col(client).cast("bigint").alias("c"), F.col(tie).cast("bigint").alias("k"), F.col(time).cast("timestamp").cast("double").alias("at"))
    return slim.groupBy("c").transformWithStateInPandas(_Limiter(limit, window_s), "c bigint, k bigint, admitted boolean", "append", "none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming DataFrame over all there is now into parquet under ``folder`` and read the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}.checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def event_stream(spark: SparkSession, directory: str, name: str = "events") -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{name}.parque[t]")


#: The parts of a request a stream of JSON lines is read for.
REQUEST = "taskId string, prompt string, iteration int, maxIterations int, siteConfigId string, currentUrl string, sendScreenshot boolean, _receivedAt double, sanitizedDom array<struct<id:string,role:string,text:string>>"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON lines in a folder, as a stream of its files; lines that are no JSON are left out."""
    lines = spark.readStream.text(folder)
    parsed = lines.select(F.from_json("value", REQUEST).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where("v is not null and r is not null").select("r.*")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts and sums in event-time windows; late rows beyond the watermark are dropped by the engine."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Session windows of each user."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
