"""Calls that may fail, and stages that need not run again."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from grainmill.sources.files import hadoop_path


def with_retries(rows: DataFrame, call: Callable[[dict, int], str], retries: int, pause: float = 1.0, most: float = 20.0) -> DataFrame:
    """``rows`` with status, attempt, waited, value and error of a call for each: ``call(row, attempt)``.

    A failed call is tried again after 1, 2, 4, ... times ``pause`` seconds, ``most`` pauses at most; ``waited`` counts pauses. A call
    that fails to the end gives an error row and never fails the job.
    """
    schema = StructType(list(rows.schema.fields)).add("status", "string").add("attempt", "long").add("waited", "long").add("value", "string").add("error", "string")

    def one(row: dict) -> tuple:
        waited, error = 0, None
        for attempt in range(1, retries + 1):
            try:
                return "ok", attempt, waited, call(row, attempt), None
            except Exception as e:  # recorded as a row
                error = f"{type(e).__name__}: {e}"[:2000]
                if attempt < retries:
                    step = int(min(2 ** (attempt - 1), most))
                    waited += step
                    time.sleep(step * pause)
        return "error", retries, waited, None, error

    def run(batches):
        for batch in batches:
            done = list(zip(*map(one, batch.to_pylist()), strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(done, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def pooled(rows: DataFrame, call: Callable[[dict], str], workers: int = 4, queued: int | None = None) -> DataFrame:
    """``rows`` with status, value and error of a call for each, ``workers`` calls at a time in every task.

    A task reads ahead no more than ``queued`` rows (twice the workers by default) and gives rows back in their order. A call
    that fails gives an error row and never fails the job. When the task ends early, because it is cancelled or its reader has
    enough, calls that have not begun are dropped.
    """
    schema = StructType(list(rows.schema.fields)).add("status", "string").add("value", "string").add("error", "string")
    most = queued or 2 * workers

    def one(row: dict) -> tuple:
        try:
            return "ok", call(row), None
        except Exception as e:  # recorded as a row
            return "error", None, f"{type(e).__name__}: {e}"[:2000]

    def table(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * 3
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), pa.string()) for c in columns)], schema.names)

    def run(batches):
        pool = ThreadPoolExecutor(workers)
        try:
            for batch in batches:
                done, waiting = [], deque()
                for i in range(batch.num_rows):
                    if len(waiting) == most:
                        done.append(waiting.popleft().result())
                    waiting.append(pool.submit(one, batch.slice(i, 1).to_pylist()[0]))
                done.extend(x.result() for x in waiting)
                yield table(batch, done)
        finally:
            pool.shutdown(wait=True, cancel_futures=True)

    return rows.mapInArrow(run, schema)


def memo(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table at ``path``, and whether it was there. Where it was not, or was left half written, it is made.

    The mark that a job writes last decides: a folder without ``_SUCCESS``, whatever files it has, is made again from the start.
    """
    fs, mark = hadoop_path(spark, f"{path.rstrip('/')}/_SUCCESS")
    there = fs.exists(mark)
    if not there:
        make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return spark.read.parquet(path), there
