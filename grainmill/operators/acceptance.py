"""Acceptance of a dataset: counted faults of manifest, lots, files and splits as one pass-or-fail report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def fault(check: str, rows: DataFrame, key: Column) -> DataFrame:
    """One row: how many faulty rows a check found and the smallest few keys. An empty table counts 0."""
    found = rows.select(key.cast("string").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
    few = found.orderBy("key").limit(5).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    # two tables of one row
    return total.join(few, F.lit(True)).select(F.lit(check).alias("check"), "bad", "examples")


def repeated(manifest: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, a row for each further time."""
    extra = manifest.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    return extra.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("time"))


def absent(manifest: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Manifest rows whose file is not there; null paths are absent too."""
    return manifest.join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def off_rule(manifest: DataFrame, rule: Column, split: str = "split") -> DataFrame:
    """Rows whose split differs from what the rule of their lot gives."""
    return manifest.where(~rule.eqNullSafe(F.col(split)))


def straddling(manifest: DataFrame, lot: str, split: str = "split") -> DataFrame:
    """Lots in more than one split; least and greatest split suffice, so no set is collected."""
    return manifest.groupBy(lot).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b")


def foreign_colours(pictures: DataFrame, key: str, colours: str, palette: list[int]) -> DataFrame:
    """Pictures (array of packed colours) with a colour outside the palette."""
    return pictures.where(F.size(F.array_except(colours, F.array(*map(F.lit, palette)))) > 0).select(key)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both tables."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def empty(check: str, rows: DataFrame) -> DataFrame:
    """A fault if the table has no row."""
    n = rows.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(check).alias("check"), (1 - F.col("n")).alias("bad"), F.array().cast("array<string>").alias("examples"))


def report(faults: list[DataFrame]) -> DataFrame:
    """check, bad, passed and examples, with a last row ``all`` that passes if every check does."""
    rows = reduce(DataFrame.unionByName, faults).withColumn("passed", F.col("bad") == 0)
    whole = rows.agg(F.lit("all").alias("check"), F.sum((~F.col("passed")).cast("long")).alias("bad"), F.array().cast("array<string>").alias("examples"), F.bool_and("passed").alias("passed"))
    return rows.unionByName(whole).select("check", "bad", "passed", "examples")
