"""Centroid clustering in whole numbers with partial-distance search.

Vectors become integers, ``floor(scale * x)`` a component. A vector's distance to a centroid is summed over the components of
highest variance first, a few at a time; a centroid is given up for a vector once the sum lies strictly above the vector's
best whole distance so far, and those that are left finish all components. The result is that of full comparison.

Spark holds the vectors: every round is one pass of Arrow tasks that send at most one row of sums a centroid, added up by a
grouped aggregation. The driver sees the sums of the centroids only, whatever the number of vectors.

Cases: vectors that are null, of another length, or with null or non-finite components take no part; nor do those whose integers lie
beyond 2^27, as squared distances of 64 of them leave 64 bits; fewer vectors than centroids give as many centroids as vectors; ties go
to the smaller number; repeated rows count as often as they occur; a null ``vec_id`` is clustered but never a first
centroid; equal ids are told apart by their components; an empty table gives an empty result; an inertia beyond 64 bits is null;
further columns of ``vectors`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.shared import discard, materialize

LARGEST = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id`` and ``v`` (array of long) of the vectors that take part."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    fine = (F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.where(F.col("vec_id").isNotNull()).orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in got], np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; ``order``: components, those to sum first in front."""
    x, c = x[:, order], centroids[:, order]
    head = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
    who = head.argmin(axis=1)  # most promising: its whole distance is the first bound
    best = ((x - c[who]) ** 2).sum(axis=1)
    begun = who.copy()
    for j in range(len(c)):
        live = np.flatnonzero((head[:, j] <= best) & (begun != j))
        total = head[live, j]
        for s in range(step, x.shape[1], step):
            if not len(live):
                break
            total = total + ((x[live, s : s + step] - c[j, s : s + step]) ** 2).sum(axis=1)
            left = total <= best[live]
            live, total = live[left], total[left]
        closer = (total < best[live]) | (j < who[live])
        who[live[closer]], best[live[closer]] = j, total[closer]
    return who, best


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Per vector its cluster, distance, the inertia of its cluster and of all, and the digest of its final centroid."""
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dims, scale), "integers")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)

    def summed(batches, work):
        """Of all batches of a task: a row of counts and sums for each number that ``work`` gives the vectors."""
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                number, x = work(x)
                count += np.bincount(number, minlength=k)
                np.add.at(total, number, x)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    def totals(work) -> list:
        parts = rows.select("v").mapInArrow(lambda batches: summed(batches, work), "cluster int, n long, total array<long>")
        return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims))).collect()  # k rows at most

    # which components vary most decides the order only, so whole numbers of squares are precise enough
    whole = totals(lambda x: (np.zeros(len(x), np.int64), x))[0]
    middle = np.array([whole[f"s{i}"] // whole["n"] for i in range(dims)])
    spread = totals(lambda x: (np.zeros(len(x), np.int64), np.minimum(np.abs(x - middle), 1 << 14) ** 2))[0]
    order = np.argsort([-spread[f"s{i}"] for i in range(dims)], kind="stable")
    for _ in range(rounds):
        for r in totals(lambda x, c=centroids: (nearest(x, c, order)[0], x)):
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                who, best = nearest(matrix(batch.column(1)), centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    out = materialize(rows.mapInArrow(placed, "vec_id long, cluster int, distance long"), "clusters")
    discard(rows)
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    known = [(c, held(s), held(sum(sums.values())), digest(c)) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
