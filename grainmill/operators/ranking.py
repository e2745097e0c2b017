"""Ranked lists: average precision, recall, discounted gain, and per-group picks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType


def normalised(v: Column) -> Column:
    """The vector scaled to length one, null if it has no length. The length is computed once, not for every component."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))
    return F.get(scaled, F.lit(0))


def cosine_topk(queries: DataFrame, gallery: DataFrame, k: int, query_rows: int = 4096, gallery_rows: int = 16_384) -> DataFrame:
    """The k most similar gallery vectors of every query, ties to the smaller id, as rank and score.

    Vectors are ``q_vec`` and ``c_vec``, of length one. Pairs with equal ``q_apart`` and ``c_apart`` are left out; further columns come
    along. Blocks of queries meet blocks of the gallery, each pair of blocks in one matrix product, and keeps its k best of a query; those
    are merged by a group-limited window. No pair of vectors is ever a row.
    """
    kept = [f for f in (*queries.schema.fields, *gallery.schema.fields) if f.name not in ("q_vec", "c_vec", "q_apart", "c_apart")]
    schema = StructType(kept).add("score", "double")
    rows, columns = (max(1, -(-df.count() // n)) for df, n in ((queries, query_rows), (gallery, gallery_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_r", F.pmod(F.xxhash64("q_id"), F.lit(rows)).cast("int")).withColumn("_c", every(columns))
    right = gallery.withColumn("_c", F.pmod(F.xxhash64("c_id"), F.lit(columns)).cast("int")).withColumn("_r", every(rows))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        at, of, scores = [], [], []
        if q.num_rows and c.num_rows:
            c = c.sort_by("c_id")
            own, vectors = c.column("c_apart").to_numpy(), matrix(c.column("c_vec"))
            for start in range(0, q.num_rows, 128):
                part = q.slice(start, 128)
                found = matrix(part.column("q_vec")) @ vectors.T
                np.round(found, 9, out=found)
                found[part.column("q_apart").to_numpy()[:, None] == own[None, :]] = -np.inf
                for i, row in enumerate(found):
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    near = near[np.isfinite(row[near])]
                    near = near[np.argsort(-row[near], kind="stable")[:k]]
                    at.append(np.full(len(near), start + i))
                    of.append(near)
                    scores.append(row[near])
        at, of, scores = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((at, np.int64), (of, np.int64), (scores, np.float64)))
        side = lambda t, i: [t.column(f.name).take(pa.array(i)) for f in kept if f.name in t.column_names]
        return pa.table([*side(q, at), *side(c, of), pa.array(scores)], names=schema.names)

    pairs = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(best, schema)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_scores(ranked: DataFrame, totals: DataFrame, ks: list[int]) -> DataFrame:
    """Per query AP@k and recall@k. ranked: q_id, rank, relevant (0/1); totals: q_id, n_relevant. No relevant: no row."""
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = ranked.withColumn("hits", F.sum("relevant").over(w))
    parts = []
    for k in ks:
        inside = F.col("rank") <= k
        parts += [F.sum(F.when(inside & (F.col("relevant") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias(f"ap{k}"), F.sum(F.when(inside, F.col("relevant")).otherwise(0)).alias(f"found{k}")]
    by = totals.where("n_relevant > 0").join(hits.groupBy("q_id").agg(*parts), "q_id", "left")
    out = by.select("q_id", *(F.coalesce(F.col(f"ap{k}"), F.lit(0.0)) / F.least("n_relevant", F.lit(k)) for k in ks), *(F.coalesce(F.col(f"found{k}"), F.lit(0)) / F.col("n_relevant") for k in ks))
    return out.toDF("q_id", *(f"ap{k}" for k in ks), *(f"recall{k}" for k in ks))


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)


def ndcg(ranked: DataFrame, ideal: DataFrame, ks: list[int]) -> DataFrame:
    """Per query ndcg{k} for every k, in one pass. ranked, ideal: q_id, rank, relevance; ideal is every judged item by falling relevance."""
    sums = lambda df, name: df.groupBy("q_id").agg(*(F.sum(F.when(F.col("rank") <= k, gain(F.col("relevance"), F.col("rank")))).alias(f"{name}{k}") for k in ks))
    both = sums(ideal, "best").join(sums(ranked, "got"), "q_id", "left")
    return both.select("q_id", *((F.coalesce(f"got{k}", F.lit(0.0)) / F.greatest(f"best{k}", F.lit(1e-12))).alias(f"ndcg{k}") for k in ks))


def pick_first(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of every group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def stratified_core(df: DataFrame, group: str, id_: str, easy: list, hard: list, limit: int, hard_share: float) -> DataFrame:
    """Per group the ``limit`` rows of a core: the easiest and, as a rounded share (half to even), the hardest ones.

    A row in both lists counts once and the next easiest rows fill up.
    """
    n_hard = round(limit * hard_share)
    ranked = df.withColumn("_e", F.row_number().over(Window.partitionBy(group).orderBy(*easy))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    from_end = F.col("_n") - F.col("_e") + 1
    take_easy = F.greatest(F.lit(limit - n_hard), F.lit(limit) - F.least(F.lit(n_hard), F.col("_n")))
    return ranked.where((F.col("_e") <= take_easy) | (from_end <= n_hard)).drop("_e", "_n")


def every_nth(df: DataFrame, group: list[str], order: list, every: int) -> DataFrame:
    """Rows 0, every, 2*every, ... of each group and its last one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
