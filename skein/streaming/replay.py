"""Streams that run over what has arrived, end, and go on from their checkpoint; their results are tables to read and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import new_folder
from .events import last_events, live_board, read_events, sse_frame


def append_log(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends what has arrived to a folder, each row once: a batch that is repeated after a failure replaces itself in the sink's own log."""
    rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batch_log(rows: DataFrame, mode: str, folder: str, checkpoint: str) -> None:
    """Writes each micro-batch of a stateful stream under its number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def board(stream: DataFrame, phases: DataFrame, folder: str, checkpoint: str) -> None:
    """Logs the whole board (phase, n) of runs(kind) after every micro-batch."""
    batch_log(live_board(stream, phases), "complete", folder, checkpoint)


def latest_board(spark: SparkSession, folder: str) -> DataFrame:
    """The board after the last micro-batch."""
    log = spark.read.parquet(folder)
    return log.join(F.broadcast(log.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def history(stream: DataFrame, key: str, n: int, folder: str, checkpoint: str) -> None:
    """Logs the last n events of every key that a micro-batch brings events of."""
    batch_log(last_events(stream, key, n), "update", folder, checkpoint)


def latest_history(spark: SparkSession, folder: str) -> DataFrame:
    """(key, ns, event_id) of each key's history as it was last logged; sums by key, no group is gathered."""
    log = spark.read.parquet(folder)
    last = log.groupBy("key").agg(F.max("batch").alias("batch"))
    return log.join(last, ["key", "batch"]).select("key", "ns", "event_id")


def frames(stream: DataFrame, payload: str, folder: str, checkpoint: str) -> None:
    """Appends (event_id, frame) of events(event_id, payload column) to a log that subscribers read."""
    append_log(stream.select("event_id", sse_frame(F.col("event_id"), F.col(payload)).alias("frame")), folder, checkpoint)


def replay(spark: SparkSession, folder: str, after: int | None = None) -> DataFrame:
    """The frames of a log that a subscriber has missed who saw event `after` last, all without one, in order of their ids."""
    log = spark.read.parquet(folder)
    return (log if after is None else log.where(F.col("event_id") > after)).orderBy("event_id")


def in_runs(rows: DataFrame, run: Callable[[DataFrame, str, str], None], runs: int = 2, files: int = 3, files_per_batch: int = 2, schema: str | None = None) -> str:
    """Lets rows(event_id, ...) arrive in `runs` shares of some files each, and run(stream, folder, checkpoint) once after each share.

    Every run but the first goes on from the checkpoint, in several micro-batches. Returns the folder of results.
    """
    spark = rows.sparkSession
    inbox, folder, checkpoint = (new_folder(spark, name) for name in ("inbox", "stream-log", "stream-checkpoint"))
    for k in range(runs):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(runs)) == k).repartition(files).write.mode("append").parquet(inbox)
        run(read_events(spark, inbox, schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), files_per_batch), folder, checkpoint)
    return folder
