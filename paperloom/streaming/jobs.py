"""Streams: inbox, rates, sessions, first sightings, counters. Each is the same function on a batch and a stream.

Event times without a zone are read as UTC. Rows later than the watermark are dropped by the stateful operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.session import ensure_checkpoint_dir


def inbox(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder, so many per trigger: the bound takes the place of a queue's depth check."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def rates(events: DataFrame, length: str = "5 minutes", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Count and sum in sliding windows per event type."""
    w = timed(events, delay).groupBy(F.window("at", length, step), "event_type")
    g = w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after a gap."""
    g = timed(events, delay).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def first_sightings(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each file of a site once within the watermark."""
    u = uploads.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return u.dropDuplicatesWithinWatermark(["owner_scope", "sha256"]) if uploads.isStreaming else u.dropDuplicates(["owner_scope", "sha256"])


def usage(events: DataFrame) -> DataFrame:
    """Running counts per user and event type (update mode on a stream)."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, ts, allowed): a window opens at a user's first event, blocks beyond the limit and closes after so many seconds.

    Batches of one user are sorted by time; the open window is the state, so a hot user costs state of one row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, count = state.get if state.exists else (None, 0)
        b = pd.concat([*batches]).sort_values("ts")
        allowed = []
        for t in b.ts.astype("int64") // 1_000 if str(b.ts.dtype) == "datetime64[ns]" else b.ts.astype("int64"):
            if opened is None or t - opened >= seconds * 1_000_000:
                opened, count = int(t), 0
            count += 1
            allowed.append(count <= limit)
        state.update((opened, count))
        yield pd.DataFrame({"user_id": key[0], "ts": b.ts, "allowed": allowed})

    s = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return s.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp, allowed boolean", "opened long, n long", "append", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, name: str, mode: str = "append", folder: str | None = None, into=None):
    """Run what is there and stop: a memory table by the name, or a function of each micro-batch."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    where = folder or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True)
    return (w.foreachBatch(into) if into else w.format("memory").queryName(name)).start()
