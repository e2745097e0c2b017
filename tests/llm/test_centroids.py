import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from grainmill.llm import queries
from grainmill.llm.centroids import cluster, nearest
from tests.core.test_queries import canonical


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < 1 << 27 for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    if not cents:
        return []
    at = place()
    inner = [sum(d for d, c in at if c == j) for j in range(len(cents))]
    return sorted(((i, c, d, inner[c], sum(inner), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    return sorted((tuple(r) for r in cluster(df).collect()), key=repr)


def floats(x):
    return [float(y) for y in np.asarray(x, np.float32)]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, floats(rng.normal(size=64) * rng.choice([0.01, 1, 20]))) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    one = floats(np.arange(64) / 7)
    rows = [(1, None), (2, []), (3, one[:63]), (4, [*one[:63], None]), (5, [*one[:63], float("nan")]), (6, [*one[:63], float("inf")]), (7, [*one[:63], 1e30]), (8, one), (8, one), (None, one), (9, [-x for x in one]), (10, [0.0] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:7]) == run(spark, []) == []


def test_partial_distances_find_what_whole_ones_find():
    rng = np.random.default_rng(9)
    x, c = rng.integers(-4, 5, (500, 64)), rng.integers(-4, 5, (16, 64))
    c[9] = c[3]  # ties go to the smaller number
    whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        who, best = nearest(x, c, order)
        assert (who == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names, df = [d[0] for d in cur.description], queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)
