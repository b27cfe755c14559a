"""Event streams: counts by window, boards, bounded histories, and frames for subscribers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def by_window(events: DataFrame, stamp: str, kind: str, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) by tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, length), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def live_board(runs: DataFrame, phases: DataFrame) -> DataFrame:
    """(phase, n) as runs(kind) arrive, for update or complete mode."""
    return runs.join(phases, "kind", "left").groupBy(F.coalesce("phase", F.lit("other")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def sse_frame(event_id: Column, payload: Column) -> Column:
    """A server-sent event: an id line, a data line for each line of the payload, and an empty one."""
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\ndata: "), F.regexp_replace(payload, "\r\n|\r|\n", "\ndata: "), F.lit("\n\n"))


def publish(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to send(batch, number); a batch that is repeated after a failure keeps its number."""
    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()


def bounded_history(events: DataFrame, key: str, stamp: str, tie: str, n: int = 200) -> DataFrame:
    """The last n events of each key, newest first."""
    w = W.partitionBy(key).orderBy(F.desc(stamp), F.desc(tie))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def last_events(events: DataFrame, key: str, n: int = 200) -> DataFrame:
    """Streaming form of bounded_history: (key, ts, event_id) of each key's last n events, as state per key.

    events has columns key, ts (timestamp) and event_id (long); every batch returns the history of its keys.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, batches, state: GroupState):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += [(int(pd.Timestamp(t).value), int(i)) for t, i in zip(b["ts"], b["event_id"], strict=True)]
        held = sorted(set(held), reverse=True)[:n]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({"key": [str(k[0])] * len(held), "ns": [h[0] for h in held], "event_id": [h[1] for h in held]})

    rows = events.select(F.col(key).cast("string").alias("key"), "ts", "event_id")
    return rows.groupBy("key").applyInPandasWithState(update, "key string, ns long, event_id long", "ns array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
