"""Approximate nearest neighbours through learned partitions of a neighbour graph.

On a bounded sample (``sample_rows`` vectors by row hash) the exact k-nearest-neighbour graph is cut into balanced partitions: seeds
far apart grow by capacity-bound assignment, then refinement sweeps move each vector to the partition where most of its
neighbours are while no partition exceeds its share by more than ``imbalance``. A softmax classifier over the vectors and
their squares, fitted by Adam, learns the partitions. Where more than ``fan`` partitions are wanted there is a second level: each
partition's own bounded sample is cut and learned by a task of its own. There are as many partitions as the root of the number of
rows, so partitions grow as that root too, and a query that visits a fixed share of them meets a fixed share of the rows. Every row
of the table is indexed in one partition. A query goes to its most probable partitions until what is left of the joint
probability is below a limit of that query set: the one at which held-out sample queries, that no router has learned, reach
``target_recall`` of their exact neighbours; sure queries visit few partitions, unsure ones many, and all as many as surely
hold k rows. What they hold is reranked by exact distance in double precision.

Partitions are dealt by (partition, salt) with at most about ``block_rows`` rows each, queries are copied to the salts of their
partitions and cut into blocks as well, every pair of blocks returns its k best per query, and a second small shuffle merges
those. No partition, however large, is one task.

Cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, as rows or as queries;
vectors of another length than most are left out too, as no distance to them is defined; repeated rows are candidates like
others; ties go to the smaller vec_id; fewer than k candidates give as many ranks; a null vec_id is a candidate but no query;
small tables are partitioned and routed like others;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.shared import materialize, revive

RESULT = "row_id long, query_id long, vec_id long, other_row long, score double"


def valid_rows(vectors: DataFrame) -> DataFrame:
    """row_id, vec_id, v (double array) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest points of every query, by blocks."""
    out = []
    norms = (points * points).sum(axis=1)
    for i in range(0, len(queries), 1024):
        d = norms - 2 * queries[i : i + 1024] @ points.T
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(points) else np.argsort(d, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, imbalance: float = 0.1, sweeps: int = 12, seed: int = 11) -> np.ndarray:
    """Partition of the graph's nodes into ``parts`` of nearly equal size with few cut edges."""
    n, rng = len(x), np.random.default_rng(seed)
    cap = int(np.ceil(n / parts * (1 + imbalance)))
    centres = [x[rng.integers(n)]]
    best = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(parts - 1):
        centres.append(x[int(rng.choice(n, p=best / best.sum())) if best.sum() > 0 else rng.integers(n)])
        best = np.minimum(best, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    part = np.zeros(n, np.int64)
    for _ in range(4):
        d = (c * c).sum(axis=1) - 2 * x @ c.T
        part = capacity_assign(-d, cap)
        c = np.array([x[part == p].mean(axis=0) if (part == p).any() else c[p] for p in range(parts)])
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(sweeps):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts).astype(float)
        votes[np.arange(n), part] += 0.5
        new = capacity_assign(votes, cap)
        if (new == part).mean() > 0.999:
            break
        part = new
    return part


def capacity_assign(gain: np.ndarray, cap: int) -> np.ndarray:
    """Every row to its best column that still has room; rows with the clearest choice first."""
    n, parts = gain.shape
    order = np.argsort(-gain, axis=1, kind="stable")
    two = np.take_along_axis(gain, order[:, :2], axis=1)
    clear = np.argsort(-(two[:, 0] - two[:, -1]), kind="stable")
    room, out, todo = np.full(parts, cap), np.full(n, -1, np.int64), clear
    for level in range(parts):
        want = order[todo, level]
        by = np.argsort(want, kind="stable")
        rank = np.empty(len(todo), np.int64)
        starts = np.searchsorted(want[by], np.arange(parts))
        rank[by] = np.arange(len(todo)) - starts[want[by]]
        ok = rank < room[want]
        out[todo[ok]] = want[ok]
        room = room - np.bincount(want[ok], minlength=parts)
        todo = todo[~ok]
        if not len(todo):
            break
    return out


class Router:
    """Softmax over vectors and their squares."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, std: np.ndarray):
        self.w, self.mean, self.std = w, mean, std

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.concatenate([z, z * z - 1, np.ones((len(x), 1))], axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.inputs(x) @ self.w
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


class Tree:
    """A router and, where the table asks for it, one below each of its partitions. Leaf numbers count through all levels."""

    def __init__(self, top: dict, below: dict[int, dict], width: int):
        self.top, self.below, self.width = top, below, width

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The partition of every row: the most probable one, level by level."""
        part = revive(Router, self.top).log_probabilities(x).argmax(axis=1)
        out = part * self.width
        for p in np.unique(part):
            if int(p) in self.below:
                at = np.flatnonzero(part == p)
                out[at] += revive(Router, self.below[int(p)]).log_probabilities(x[at]).argmax(axis=1)
        return out

    def ranked(self, x: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``leaves`` for every row, most probable first, and the probability of each and all behind it."""
        top = revive(Router, self.top).log_probabilities(x)
        joint = np.full((len(x), top.shape[1] * self.width), -np.inf)
        joint[:, :: self.width] = top
        for p, state in self.below.items():
            own = revive(Router, state).log_probabilities(x)
            joint[:, p * self.width : p * self.width + own.shape[1]] = top[:, [p]] + own
        order = np.argsort(-joint[:, leaves], axis=1, kind="stable")
        share = np.exp(np.take_along_axis(joint[:, leaves], order, axis=1))
        return leaves[order], np.cumsum(share[:, ::-1], axis=1)[:, ::-1]


def fit_router(x: np.ndarray, wanted: np.ndarray, steps: int = 200, rate: float = 0.05) -> Router:
    """``wanted``: the share of each row's neighbours in each partition, which is what a query must be led by."""
    r = Router(np.zeros((2 * x.shape[1] + 1, wanted.shape[1])), x.mean(axis=0), x.std(axis=0) + 1e-9)
    z, a, b = r.inputs(x), 0.0, 0.0
    for t in range(1, steps + 1):
        s = z @ r.w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = z.T @ (p / p.sum(axis=1, keepdims=True) - wanted) / len(x) + 2e-3 * r.w
        a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
        r.w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return r


def learn(x: np.ndarray, parts: int, k: int) -> Router:
    """Cut the neighbour graph of a sample and learn the partitions."""
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    parts = max(1, min(parts, len(x)))
    graph = nearest(x, x, min(k + 1, len(x)))
    part = balanced_partition(x, graph, parts)
    near = np.zeros((len(x), parts))
    np.add.at(near, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    return fit_router(x, near)


def sampled(rows: DataFrame, share: Column, seed: str) -> DataFrame:
    """Rows by a hash of their number; ``share``: of each row, 0 to 1."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 30)) < share * float(1 << 30))


def fit(rows: DataFrame, n: int, k: int, sample_rows: int, fan: int, held_rows: int = 400) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree of routers, the vectors that it was learned from, and others to set the limit of a search with."""
    got = sampled(rows, F.lit(min(1.0, 1.05 * sample_rows / n)), "ann").select("v", F.xxhash64(F.lit("order"), "row_id").alias("o")).limit(2 * sample_rows).toArrow().sort_by("o")
    x = np.unique(vectors_of(got.column("v")), axis=0)
    x = x[np.random.default_rng(5).permutation(len(x))]
    held = x[: max(1, min(held_rows, len(x) // 5))]
    wanted = max(2, round(n**0.5))
    top = learn(x[len(held) :] if len(x) > 1 else x, min(wanted, fan), k)
    width = min(fan, -(-wanted // fan)) if wanted > fan else 1
    tree = Tree(vars(top), {}, width)
    if width == 1:
        return tree, x, held
    shared = rows.sparkSession.sparkContext.broadcast(vars(tree))

    def place(batches):
        for batch in batches:
            part = revive(Tree, shared.value).leaf(vectors_of(batch.column(1))) // width
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["row_id", "v", "part"])

    def below(table: pa.Table) -> pa.Table:
        r = learn(vectors_of(table.column("v")), width, k)
        parts = pa.array([table.column("part")[0].as_py()], pa.int32())
        return pa.table([parts, *(pa.array([z.ravel()], pa.list_(pa.float64())) for z in (r.w, r.mean, r.std))], names=["part", "w", "mean", "std"])

    # one sample for all second-level models, bounded for each of them by the balance of the first level
    own = sampled(rows, F.lit(min(1.0, fan * sample_rows / 2 / n)), "below").select("row_id", "v").mapInArrow(place, "row_id long, v array<double>, part int")
    models = own.groupBy("part").applyInArrow(below, "part int, w array<double>, mean array<double>, std array<double>")
    for m in models.toArrow().to_pylist():  # at most ``fan`` rows
        mean = np.array(m["mean"])
        tree.below[m["part"]] = vars(Router(np.array(m["w"]).reshape(2 * len(mean) + 1, -1), mean, np.array(m["std"])))
    return tree, x, held


def limit_of(tree: Tree, x: np.ndarray, held: np.ndarray, leaves: np.ndarray, k: int, target_recall: float) -> float:
    """The rest of probability at which a query stops, so that ``held`` queries reach the recall among the vectors ``x``."""
    truth = nearest(held, x, min(k + 1, len(x)))
    order, rest = tree.ranked(held, leaves)
    place = np.argsort(np.searchsorted(leaves, order), axis=1)
    at = np.minimum(np.searchsorted(leaves, tree.leaf(x)[truth]), len(leaves) - 1)
    reached = np.take_along_axis(rest, np.take_along_axis(place, at, axis=1), axis=1)
    others = (x[truth] != held[:, None]).any(axis=2)
    reached = np.sort(reached[others])[::-1]
    return float(reached[min(len(reached) - 1, int(np.ceil(target_recall * len(reached))) - 1)]) if len(reached) else 0.0


def visited(tree: Tree, x: np.ndarray, leaves: np.ndarray, limit: float, least: int) -> list[np.ndarray]:
    """The partitions that each row visits: those before which at least ``limit`` of the probability is left, and ``least`` at least."""
    order, rest = tree.ranked(x, leaves)
    return [o[: max(least, int((r >= limit * (1 - 1e-9)).sum()))].astype(np.int32) for o, r in zip(order, rest, strict=True)]


def vectors_of(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query, k: int = 10, sample_rows: int = 8000, fan: int | None = None, target_recall: float = 0.94, block_rows: int = 8192, query_rows: int = 16_384) -> DataFrame:
    """The k nearest rows found of every query row: query_id, rank, vec_id, score.

    ``fan``: partitions of a level, by default 64 or the fourth root of the number of rows.
    """
    spark = vectors.sparkSession
    rows = materialize(valid_rows(vectors), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, n = rows.where(F.size("v") == lengths[0]["d"]), lengths[0]["count"]
    fan = fan or max(64, round(n**0.25))
    tree, sample, held = fit(rows, n, k, sample_rows, fan)
    shared = spark.sparkContext.broadcast(vars(tree))

    def index(batches):
        for batch in batches:
            leaf = revive(Tree, shared.value).leaf(vectors_of(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "part"])

    indexed = materialize(rows.mapInArrow(index, "row_id long, vec_id long, v array<double>, part int"), "indexed")
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # at most fan * fan rows
    leaves = np.array(sorted(sizes))
    # as many as hold k others whichever they are
    least = int(np.searchsorted(np.cumsum(sorted(sizes.values())), min(k + 1, n))) + 1
    limit = limit_of(tree, sample, held, leaves, k, target_recall)

    def route(batches):
        for batch in batches:
            parts = visited(revive(Tree, shared.value), vectors_of(batch.column(2)), leaves, limit, least) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    salts = {p: max(1, -(-c // block_rows)) for p, c in sizes.items()}
    queries = rows.where(is_query).mapInArrow(route, "row_id long, vec_id long, v array<double>, parts array<int>").select("row_id", "vec_id", "v", F.explode("parts").alias("part"))
    # a partition that very many queries visit has them in several blocks, and its rows are copied once for each
    callers = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}  # at most fan * fan rows
    cuts = [(p, salts[p], max(1, -(-callers.get(p, 0) // (salts[p] * query_rows)))) for p in sorted(salts)]
    cuts = F.broadcast(spark.createDataFrame(cuts, "part int, salts int, chunks int"))
    data = indexed.join(cuts, "part").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int"))
    data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    queries = queries.join(cuts, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit("q"), "row_id"), F.col("chunks")).cast("int")).drop("salts", "chunks")

    def rerank(queries: pa.Table, data: pa.Table) -> pa.Table:
        found = ([], [], [], [], [])
        if queries.num_rows and data.num_rows:
            x = data.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(data.num_rows, -1)
            ids, at = data.column("vec_id").to_numpy(zero_copy_only=False), data.column("row_id").to_numpy()
            order_id = np.where(np.isnan(ids), np.inf, ids) if ids.dtype.kind == "f" else ids
            norms = (x * x).sum(axis=1)
            q_all = queries.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(queries.num_rows, -1)
            q_ids, q_rows = queries.column("vec_id").to_numpy(), queries.column("row_id").to_numpy()
            for i in range(0, len(q_all), 256):
                q = q_all[i : i + 256]
                rough = norms - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
                keep = min(k + 1, len(x))
                limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
                # everything that rounding could have put behind the limit is compared exactly
                near = rough <= (limit + 1e-9 * (np.abs(limit) + norms.max() + (q * q).sum(axis=1)))[:, None]
                for j in range(len(q)):
                    c = np.flatnonzero(near[j])
                    c = c[at[c] != q_rows[i + j]]
                    d = np.sqrt(((x[c] - q[j]) ** 2).sum(axis=1))
                    c, d = (z[np.lexsort((at[c], order_id[c], d))[:k]] for z in (c, d))
                    for out, value in zip(found, (np.full(len(c), q_rows[i + j]), np.full(len(c), q_ids[i + j]), c, at[c], d), strict=True):
                        out.append(value)
        if not found[0]:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["row_id", "query_id", "vec_id", "other_row", "score"])
        row, qid, c, other, d = (np.concatenate(z) for z in found)
        return pa.table([pa.array(row), pa.array(qid), data.column("vec_id").combine_chunks().take(pa.array(c)), pa.array(other), pa.array(d)], names=["row_id", "query_id", "vec_id", "other_row", "score"])

    keys = ["part", "salt", "chunk"]
    best = queries.groupBy(*keys).cogroup(data.select("row_id", "vec_id", "v", *keys).groupBy(*keys)).applyInArrow(rerank, RESULT)
    # a query has at most k rows of each block that it met
    top = F.slice(F.array_sort(F.collect_list(F.struct("score", F.col("vec_id").isNull().alias("no_id"), "vec_id", "other_row"))), 1, k)
    merged = best.groupBy("row_id", "query_id").agg(top.alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
