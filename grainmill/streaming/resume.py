"""Streams: the resumable annotation log, the budget stop and windowed event counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resume(requests: DataFrame, log_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, schema: str) -> StreamingQuery:
    """Works on the requests (a stream with ``id``) that the log has no ``ok`` row for; errors are tried again.

    A batch reads the log without its own folder, leaves out what is done and writes its rows, errors too, to its own folder
    (``run=<hash of the checkpoint>/batch=<number>``); a batch that runs again after a failure replaces that folder.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, number: int) -> None:
        spark, own = df.sparkSession, f"run={run}/batch={number}"
        try:
            log = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(log_path)
            log = log.where(~F.contains("_metadata.file_path", F.lit(f"/{own}/")))
            todo = df.dropDuplicates(["id"]).join(log.where("status = 'ok'").select("id"), "id", "left_anti")
        except Exception as e:  # the log does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = df.dropDuplicates(["id"])
        work(todo).write.mode("overwrite").json(f"{log_path.rstrip('/')}/{own}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def budget_stop(calls: DataFrame, budget: float) -> DataFrame:
    """Calls (user_id, event_id, value, failed) of a stream that are made before their user's budget is reached or one failed.

    The crossing call is kept. State per user: what is spent and whether it has stopped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, stopped = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for r in rows.itertuples(index=False):
            if stopped or spent >= budget:
                break
            out.append((key[0], r.event_id, r.value))
            spent, stopped = spent + r.value, bool(r.failed)
        state.update((spent, stopped))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value"])

    return calls.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", "spent double, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling-window counts and sums by event type, late rows accepted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Activity sessions of every user, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
