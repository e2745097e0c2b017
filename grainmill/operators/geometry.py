"""Geometry of grouped points and cells as set operations: closed forms over sums, no per-group code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


TILE = 60  # columns of a row that share a word, which has a bit more on either side


def neighbours(cells: DataFrame) -> DataFrame:
    """Every different cell (g, r, c) with the number of cells in its 3x3 field, itself included.

    A cell is a bit in a word of its row, and at the edge of a tile also in the word beside it. Bits are told to the rows above and
    below, and words are joined bit by bit before and after the one shuffle, which so carries words and not cells, whatever the
    group sizes. A cell that comes twice counts once.
    """
    tile, spot = F.floor(F.col("c") / TILE), F.pmod("c", F.lit(TILE)).cast("int") + 1
    word = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    first, last = F.when(spot == 1, word(tile - 1, F.lit(TILE + 1))), F.when(spot == TILE, word(tile + 1, F.lit(0)))
    spots = F.array_compact(F.array(word(tile, spot), first, last))
    told = cells.where("r IS NOT NULL AND c IS NOT NULL AND g IS NOT NULL").select("g", "r", F.explode(spots).alias("w")).select("g", "w.t", "r", F.expr("shiftleft(1L, w.s)").alias("bit"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("step"))
    row = lambda step: F.coalesce(F.bit_or(F.when(F.col("step") == step, F.col("bit"))), F.lit(0).cast("long"))
    words = told.groupBy("g", "t", (F.col("r") + F.col("step")).alias("r")).agg(row(1).alias("above"), row(0).alias("own"), row(-1).alias("below"))
    spread = words.where("own <> 0").select("g", "t", "r", "above", "own", "below", F.explode(F.sequence(F.lit(1), F.lit(TILE))).alias("s"))
    three = lambda name: F.expr(f"bit_count(shiftright({name}, s - 1) & 7L)")
    n = (three("above") + three("own") + three("below")).cast("long")
    found = spread.where("shiftright(own, s) & 1L = 1")
    return found.select("g", "r", (F.col("t") * TILE + F.col("s") - 1).cast(cells.schema["c"].dataType).alias("c"), n.alias("n"))


def circle_fit(points: DataFrame) -> DataFrame:
    """Least-squares circle of every group's points (g, x, y) from centred sums by Cramer's rule; null if they lie on a line."""
    mean = points.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(mean, "g").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    u, v = F.col("u"), F.col("v")
    s = p.groupBy("g").agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), (F.sum(u * u * u) + F.sum(u * v * v)).alias("a"), (F.sum(v * v * v) + F.sum(v * u * u)).alias("b"), F.count(F.lit(1)).alias("n"))
    det = F.expr("2 * (uu * vv - uv * uv)")
    s = s.withColumn("du", F.try_divide(F.expr("a * vv - b * uv"), det)).withColumn("dv", F.try_divide(F.expr("b * uu - a * uv"), det))
    return s.select("g", F.expr("mx + du").alias("cx"), F.expr("my + dv").alias("cy"), F.sqrt(F.expr("du * du + dv * dv + (uu + vv) / n")).alias("radius"))


def shares(points: DataFrame) -> DataFrame:
    """Share of every bin of a group's points (g, bin)."""
    n = points.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("g")))


def anisotropy(points: DataFrame) -> DataFrame:
    """Smaller over larger eigenvalue of the sample covariance of every group; 0 for fewer than two points."""
    s = points.groupBy("g").agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"), F.count(F.lit(1)).alias("n"))
    half, root = F.expr("(a + b) / 2"), F.expr("sqrt(pow((a - b) / 2, 2) + c * c)")
    return s.select("g", F.when(F.col("n") < 2, 0.0).otherwise((half - root) / F.greatest(half + root, F.lit(1e-12))).alias("ratio"))
