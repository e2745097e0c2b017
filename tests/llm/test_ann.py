import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import ann
from grainmill.llm.ann import balanced_partition, nearest, search

SCHEMA = "vec_id long, embedding array<float>, part int"


def brute(rows, k):
    good = [(r, i, np.array(v, np.float32).astype(float)) for r, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for r, i, v in good:
        if i is not None and i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0, s) for s, j, w in good if s != r)
            out.setdefault(i, []).append([(d, None if none else j) for d, none, j, _ in near[:k]])
    return out


def run(spark, rows, k=10, **parameters):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).coalesce(1)
    out = {}
    for r in search(df, F.col("vec_id") % 100 == 0, k, **parameters).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    return {q: [t[i] for i in sorted(t)] for q, t in out.items()}


def test_all_candidates_where_few_and_ties_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(350)]
    rows += [(400 + i, rows[0][1]) for i in range(25)] + [(500, None), (501, []), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, [1.0, None] * 4), (900, [float("inf")] * 8), (None, rows[7][1])]
    got, want = run(spark, rows, fan=1), brute(rows, 10)  # one partition: exact
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q][0]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q][0]], atol=0, rtol=1e-15)


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]) == {0: [(1.0, 1)]}


def exact_registered(spark, folder):
    from grainmill.llm.queries import op7_ann

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in op7_ann(spark, folder).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 10)
    return sum(len(set(got[q]) & {i for _, i in w[0]}) for q, w in want.items()) / sum(len(w[0]) for w in want.values())


def counted(monkeypatch):
    """Notes the partitions, and those that held-out queries visit under the limit that a search sets."""
    seen, limit_of = [], ann.limit_of

    def noted(tree, x, held, leaves, *a):
        limit = limit_of(tree, x, held, leaves, *a)
        seen.append((len(leaves), np.mean([len(v) for v in ann.visited(tree, held, leaves, limit, 1)])))
        return limit

    monkeypatch.setattr(ann, "limit_of", noted)
    return seen


@pytest.mark.parametrize("sf,most", [("sf0.01", 0.9), ("sf0.1", 0.8)])
def test_registered_query_visits_a_part_and_finds_most(spark, sf, most, monkeypatch):
    """The given vectors have hardly any neighbourhoods, so the part is large."""
    seen = counted(monkeypatch)
    assert exact_registered(spark, f"/root/testdata/{sf}") >= 0.9
    assert seen[0][1] <= most * seen[0][0]


@pytest.mark.parametrize("fan", [128, 9])
def test_recall_of_learned_partitions(spark, fan, monkeypatch):
    seen = counted(monkeypatch)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=6000)] + 0.4 * rng.normal(size=(6000, 16))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())] + [(10_000 + i, x[5].astype(np.float32).tolist()) for i in range(600)]
    got = run(spark, rows, sample_rows=3000, fan=fan, block_rows=300)
    data = np.array([v for _, v in rows])
    hits = total = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        limit = np.sort(d)[9]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        hits += sum(s <= limit + 1e-9 for s, _ in got[q])
        total += 10
    assert hits / total >= 0.9
    assert seen[0][1] * 3 <= seen[0][0]  # clustered vectors need few of the partitions


def test_partition_is_balanced():
    x = np.random.default_rng(2).normal(size=(900, 4))
    part = balanced_partition(x, nearest(x, x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(150 * 1.1)
