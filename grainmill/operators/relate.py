"""Joins and set operations of the evaluation library: last-wins, fallback and positional joins, range and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.session import keep


def last_per_key(df: DataFrame, key: str, order: str, keep: Column) -> DataFrame:
    """The last row of every key that satisfies ``keep``, as one mergeable aggregate."""
    row = F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("row")
    return df.where(keep).groupBy(key).agg(row).select(key, "row.*")


def with_position(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """A dense position by a total order, without one task for all rows: ranges are numbered by their counts.

    Rows are range-partitioned, counted per partition, and numbered inside it from the sum of the counts before.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    stored = keep(sorted_)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stored.join(starts.select("_part", "_first", "_start"), "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def align(gold: DataFrame, answers: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Answers by key; where a key has none, by position. Gold and answers carry ``pos``; answers carry ``answer``."""
    by_key = gold.join(answers.select(*key, F.col("answer").alias("by_key")).dropDuplicates(key), key, "left")
    by_pos = by_key.join(answers.select(pos, F.col("answer").alias("by_pos")), pos, "left")
    return by_pos.withColumn("answer", F.coalesce("by_key", "by_pos"))


def near_join(a: DataFrame, b: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """Pairs with |x - y| <= tolerance as an equi-join on buckets as wide as the tolerance; b is copied to three buckets."""
    left = a.withColumn("_b", F.floor(F.col(x) / tolerance))
    right = b.withColumn("_b", F.explode(F.array(*(F.floor(F.col(y) / tolerance) + k for k in (-1, 0, 1)))))
    return left.join(right, "_b").where(F.abs(F.col(x) - F.col(y)) <= tolerance).drop("_b")


def covered(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    """Points with the number of spans of their group that hold them, by a sweep: +1 at a start, -1 after an end.

    Ends and starts are summed in order within the group, so spans are never paired with points.
    """
    events = spans.select(group, F.col(start).alias("_at"), F.lit(0).alias("_k"), F.lit(1).alias("_d")).unionByName(spans.select(group, (F.col(end) + 1).alias("_at"), F.lit(0).alias("_k"), F.lit(-1).alias("_d")))
    probe = points.select(group, F.col(at).alias("_at"), F.lit(1).alias("_k"), F.lit(0).alias("_d"))
    w = Window.partitionBy(group).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.unionByName(probe).withColumn("covers", F.sum("_d").over(w)).where("_k = 1").select(group, F.col("_at").alias(at), "covers")
