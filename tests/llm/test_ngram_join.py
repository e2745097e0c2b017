import inspect
import random
import re
import tracemalloc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm.ngram_join import _batches, bitmap, components, planes, shared_counts, unplanes
from grainmill.llm.shared import small_batches


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, t):
    sets, root = [shingles(x, k) for _, x in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= t * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, k, t):
    df = spark.createDataFrame([(d, x, "q") for d, x in rows], "doc_id long, text string, n string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in components(df, k, t).collect())


@pytest.mark.parametrize("t", [60, 85])
def test_matches_brute_force(spark, t):
    rng = random.Random(t)
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghij") * rng.randint(1, 3)
        else:
            w = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))]
        rows.append((1000 - i, " ".join(w)))
    assert run(spark, rows, 4, t) == brute(rows, 4, t)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, long), (8, long + " x"), (9, "é x É x"), (9, "é x É x")]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert run(spark, [], 4, 85) == []


def test_bitmap_never_differs_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n in (1, 30, 300, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 7).astype(np.uint64)])
        differ = np.bitwise_count((bitmap(a) ^ bitmap(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))
    assert not (bitmap(a) ^ bitmap(a[::-1])).any()


def test_near_misses_around_one_text(spark):
    """Many texts a few edits from one: most pairs fail by little, some chains link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(120), rng.randint(1, 9)):
            w[j] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def portions(batches):
    """What the counting step gives for Arrow batches of (row_id, doc_id, text)."""
    return list(_batches([pa.record_batch([pa.array([r for r, _ in b], pa.int64()), pa.array([r for r, _ in b], pa.int64()), pa.array([x for _, x in b], pa.string())], ["row_id", "doc_id", "text"]) for b in batches], 3))


def test_portions_do_not_follow_batches():
    rows = [(i, " ".join(f"w{i * j % 91}" for j in range(50)) if i % 7 else None) for i in range(200)]
    (one,), (many,) = portions([rows]), portions([rows[i : i + 3] for i in range(0, 200, 3)] + [[]])
    assert one[0] == many[0] == 0
    assert all(np.array_equal(a, b) for a, b in zip(one[1:], many[1:], strict=True))
    assert portions([[]]) == []
    assert [len(p[1]) for p in portions([[(i, None) for i in range(6_000)]] * 5)] == [12_000, 12_000, 6_000]


def test_counting_holds_a_range_about_once():
    """A range of 1.6 million shingles (12 bytes each), most of them alone, in small batches."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 8_000), np.arange(i % 5, 90, 5)]).astype(np.uint64)) for i in range(200)]
    copies = [np.where(s == 7, 2, 1).astype(np.uint32) for s in sets]

    def source():
        for i in range(0, 200, 10):
            own = range(i, i + 10)
            yield pa.record_batch([pa.array([0] * 10, pa.int32()), pa.array(own, pa.int64()), pa.array([5] * 10, pa.int64()), pa.array([len(sets[j]) + 5 for j in own], pa.int64()), pa.array([planes(sets[j]) for j in own], pa.binary()), pa.array([planes(copies[j]) for j in own], pa.binary())], ["part", "batch", "base", "total", "tokens", "counts"])

    want = Counter()
    for s, c in zip(sets, copies, strict=True):
        want.update({int(t): int(n) for t, n in zip(s[s < 90], c[s < 90], strict=True)})
    tracemalloc.start()
    seen, out = 0, []
    for b in shared_counts(source()):
        out += b.to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for r in out:
        tokens, freq, at = unplanes(r["tokens"], np.uint64), unplanes(r["freq"], np.uint32), unplanes(r["at"], np.uint32)
        assert np.array_equal(sets[r["batch"]][at - 5], tokens)
        assert [want[t] for t in tokens.tolist()] == freq.tolist()
        seen += len(tokens)
    assert [r["batch"] for r in out] == list(range(200))
    assert seen == sum((s < 90).sum() for s in sets)
    assert peak < 4 * 12 * sum(map(len, sets))


def test_texts_come_in_small_batches(spark):
    docs = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("some words "), 50_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    seen = lambda: [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    with small_batches(spark):
        assert max(seen()) * 550_000 < 6 << 20
    assert seen() == [40]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    try:
        with small_batches(spark):
            assert max(seen()) <= 3
        assert max(seen()) <= 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_components_are_formed_again_only_for_new_links(spark, monkeypatch):
    from grainmill.llm import ngram_join

    calls, inner = [], ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda links: calls.append(1) or inner(links))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(4)] + [(9, "quite another text of its own with a few more words")]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert len(calls) == 1  # three times before: the other searches found no link


def test_tasks_give_memory_back(monkeypatch):
    from grainmill.llm import shared

    done = []
    monkeypatch.setattr(shared, "release", lambda: done.append(1))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from source

    tidied = shared.tidy(batches)
    assert tidied.__annotations__ == batches.__annotations__ and inspect.isgeneratorfunction(tidied)
    assert list(tidied(iter([1, 2]))) == [1, 2] and len(done) == 1
    assert shared.tidy(lambda table: table)(3) == 3 and len(done) == 2
