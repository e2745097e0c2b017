"""Helpers that several training-data operators share: durable intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.session import shared_dir as work_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing reads any more."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow tasks that run meanwhile get batches of about ``most`` bytes, unless the session has a bound of its own.

    Spark's default of 64 MB is held several times over: as it is written, as it is read, and as the next one comes.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name)


def release() -> None:
    """Gives the memory that this process no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A function of batches, or of one group, that calls ``release`` when it ends: Python workers live on through later stages."""

    @functools.wraps(task)
    def of_batches(batches):
        yield from task(batches)
        release()

    @functools.wraps(task)
    def of_group(group):
        out = task(group)
        release()
        return out

    return of_batches if inspect.isgeneratorfunction(task) else of_group


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from every column of ``df``, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


HOT_SHARE = 1000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys that hold more than a thousandth of ``total`` rows, so fewer than a thousand, and the salts to split each into."""
    return F.broadcast(counts.where(F.col(n) * HOT_SHARE > total).select(*keys, (F.floor(F.col(n) * HOT_SHARE / max(total, 1)) + 1).cast("int").alias("_salts")))


def join_salted(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, scatter: Column, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which is unique on ``keys``: a hot key's rows are dealt to its salts by ``scatter``, its one row is copied to them.

    All salts together are two thousand copies at most, whatever the size of the tables.
    """
    both = big.select("*", *(F.lit(0).alias(c) for c in small.columns if c not in big.columns))
    salt, many = fresh(both, "_salt"), fresh(both, "_salts")
    hot, salts = hot.withColumnRenamed("_salts", many), F.coalesce(many, F.lit(1))
    left = big.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(F.lit("salt"), scatter), salts).cast("int")).drop(many)
    right = small.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1))).drop(many)
    return left.join(right, [*keys, salt], how).drop(salt)


def join_counted(big: DataFrame, small: DataFrame, key: str, scatter: Column) -> DataFrame:
    """``join_salted`` for a materialised ``big`` whose keys are counted first."""
    hot = hot_keys(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), [key], "_n", big.count())
    return join_salted(big, small, [key], hot, scatter)


def revive(kind: type, state: dict | None):
    """An object from its attributes. Broadcasts carry plain attributes, as executors need not have this package."""
    if state is None:
        return None
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected graph, by alternating large-star and small-star steps.

    ``edges``: columns ``a``, ``b`` (long). Returns ``node``, ``comp``. The number of rounds grows with the logarithm of
    the longest path. A large star hangs all larger neighbours of a node below its smallest one, so a hub's rows only
    pass through a grouped minimum and an equi-join; no adjacency list is ever built.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if cur.isEmpty():  # dozens of small joins are not planned for nothing
        return nodes.select("node", F.col("node").alias("comp"))
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m"))).distinct()
        last, cur = cur, materialize(nxt, "cc")
        discard(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("u").agg(F.min("v").alias("comp"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("comp", "node").alias("comp"))
