"""Attempts as a stream: windowed progress with late data, and the state of each item with leases that run out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share; one of this machine only where none is set and all run on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="loomwork-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def progress(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and type; events later than ``late`` behind the newest are dropped."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def item_states(events: DataFrame, max_attempts: int = 3, lease_seconds: int = 300, late: str = "10 seconds") -> DataFrame:
    """Each item's attempts, status and reason as they change; a running attempt that outlives its lease becomes retryable.

    ``events``: uid string, outcome string, ts timestamp. State is one count and
    one status per item. Leases run on event time, so a replay gives the same.
    """

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, status = state.get if state.exists else (0, "pending")
        reason = "attempt"
        if state.hasTimedOut:
            if status == "running":
                status, reason = ("failed-retryable" if count < max_attempts else "failed-final"), "lease"
            state.update((count, status))
        else:
            last = 0
            for frame in frames:
                frame = frame.sort_values("ts")
                last = max(last, int(frame["ts"].iloc[-1].timestamp() * 1000))
                for outcome in frame["outcome"]:
                    count += 1
                    status = {"succeeded": "succeeded", "running": "running"}.get(outcome) or ("failed-retryable" if outcome == "failed-retryable" and count < max_attempts else "failed-final")
            state.update((count, status))
            if status == "running":
                state.setTimeoutTimestamp(max(last + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"uid": [key[0]], "attempt_count": [count], "status": [status], "reason": [reason]})

    return events.withWatermark("ts", late).groupBy("uid").applyInPandasWithState(update, "uid string, attempt_count long, status string, reason string", "attempt_count long, status string", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream over files has now, as a table: the last result in complete mode, every change in update mode."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{'last' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{'last' if mode == 'complete' else '*'}")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, timestamps taken as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
